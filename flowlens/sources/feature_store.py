"""Feature store: one row per window, partitioned by split, with a metadata record."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.numeric import finite_or_zero_array

WINDOWS, METADATA = "windows", "metadata"


class FeatureStore:
    """Windows as ``(day, split, seq, y, <feature> array...)`` in Parquet.

    Each feature is its own array column, so a reader of three features reads three columns,
    and statistics or scaling of a window need no shuffle.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def _path(self, part: str) -> str:
        return os.path.join(self.base, part)

    def save(self, windows: DataFrame, features: Sequence[str], length: int,
             mode: str = "overwrite") -> DataFrame:
        """Write windows, then the metadata; the metadata marks a finished store."""
        windows.write.mode(mode).partitionBy("split").parquet(self._path(WINDOWS))
        written = self.spark.read.schema(windows.schema).parquet(self._path(WINDOWS))
        sizes = {s: F.count_if(F.col("split") == s).alias(f"{s}_windows")
                 for s in ("train", "val", "test")}
        meta = written.agg(*sizes.values()).select(
            F.lit(length).alias("sequence_length"),
            F.lit(len(features)).alias("final_feature_dimension"),
            *[F.array(F.col(f"{s}_windows"), F.lit(length), F.lit(len(features)))
              .alias(f"{s}_shape") for s in sizes],
            F.array(*map(F.lit, features)).alias("feature_names"))
        meta.coalesce(1).write.mode(mode).json(self._path(METADATA))
        return self.metadata()

    def metadata(self) -> DataFrame:
        return self.spark.read.schema(
            "sequence_length int, final_feature_dimension int, train_shape array<bigint>, "
            "val_shape array<bigint>, test_shape array<bigint>, feature_names array<string>"
        ).json(self._path(METADATA))

    def feature_names(self) -> list[str]:
        return list(self.metadata().first()["feature_names"])

    def load(self) -> DataFrame:
        """Stored windows; NaN and infinities become 0."""
        df = self.spark.read.parquet(self._path(WINDOWS))
        return df.withColumns({f: finite_or_zero_array(F.col(f"`{f}`"))
                               for f in self.feature_names()})

    def exists(self) -> bool:
        """True once windows and metadata have both been written."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(METADATA))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            os.path.join(self._path(METADATA), "_SUCCESS"))
        return bool(fs.exists(done))
