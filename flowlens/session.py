"""Session builder and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Largest side that may be broadcast. Checked with a bounded count, never assumed.
BROADCAST_ROW_LIMIT = 200_000
# Most bytes of a side that is collected to be sent to every worker; summed up before.
BROADCAST_BYTES = 32 << 20


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "flowlens", **conf: str) -> SparkSession:
    """Spark session with the settings every operator expects.

    On a cluster ``master`` and the shuffle width come from ``spark-submit``;
    AQE coalesces and splits shuffle partitions at run time.
    """
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the one the cluster names, else a local one (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    named = spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    named = tempfile.mkdtemp(prefix="flowlens-stage-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir() or named


def stage(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write an expensive intermediate once as Parquet and read it back.

    Used where several passes follow. Column pruning still applies to the copy and
    it outlives lost executors, which a cached or locally checkpointed frame does not.
    Rows of megabytes need ``file_rows``, the most of a file: a task holds thousands of rows
    of a file at once, both when it writes and when it reads.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True if ``df`` holds at most ``limit`` rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint behind a size check; beyond it the planner picks a shuffle join."""
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame, few: int = 64) -> DataFrame:
    """Use all cores on an input of few splits; an input of many splits is left as it is.

    A file with one row group is one task, however dear its rows are. Beyond ``few`` splits
    the input is large enough to fill the cluster and moving it would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, few) else df
