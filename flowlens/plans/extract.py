"""From a folder of daily CSV files to a feature store."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowlens import fixed_values as fv
from flowlens.operators.selection import kept_features
from flowlens.operators.windows import (require_splits, split_summary, window_rows, window_table)
from flowlens.session import stage
from flowlens.sources.day_csv import (ROW_ORDER, audit_files, audit_table, damaged_rows, days_of, discover_csv_files,
                                      read_days)
from flowlens.sources.feature_store import FeatureStore


@dataclass(frozen=True)
class Extraction:
    metadata: DataFrame
    skipped: DataFrame       # days that could not be used, with the reason
    summary: DataFrame       # windows and attacks per split
    audit: DataFrame         # size, columns, missing values and damaged rows of every file
    damaged: DataFrame       # rows that were set aside, with the reason


def build_features(spark: SparkSession, csv_dir: str, store_dir: str,
                   length: int = fv.WINDOW_LENGTH, step: int = 1,
                   force: bool = False) -> Extraction | None:
    """Extract, split, window and store all days; None if the store is already there.

    Every file is audited first; the audit and the damaged rows lie beside the windows.
    The typed rows are written once: parsing CSV is the dear part and the positions, the
    windows and the variance filter all read them. Feature names come from the first usable
    day, other days are aligned to it by name.
    """
    store = FeatureStore(spark, store_dir)
    if store.exists() and not force:
        return None
    checked = audit_files(spark, discover_csv_files(spark, csv_dir))
    audit = _beside(spark, store_dir, "audit", audit_table(spark, checked))
    days, skipped = days_of(spark, checked)
    if not days:
        raise ValueError(f"no usable day in {csv_dir}")
    features = days[0].features
    damaged = _beside(spark, store_dir, "damaged", damaged_rows(spark, days))
    rows = stage(read_days(spark, days, features), "days")
    windowed = stage(window_rows(rows, ROW_ORDER, step, length), "windows")
    kept = kept_features(windowed.where("split = 'train'"), features)
    table = stage(window_table(windowed, kept), "window-table")
    summary = split_summary(table)
    require_splits(summary)
    return Extraction(store.save(table, kept, length), skipped, summary, audit, damaged)


def _beside(spark: SparkSession, store_dir: str, name: str, table: DataFrame) -> DataFrame:
    """The table, written beside the store's windows."""
    path = os.path.join(store_dir, name)
    table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path)
