"""Day audit and column discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def find_column(columns: Sequence[str], part: str) -> str | None:
    """First column whose lower-case name contains ``part``."""
    return next((c for c in columns if part in c.lower()), None)


def find_label_column(columns: Sequence[str]) -> str | None:
    return find_column(columns, "label")


def find_timestamp_column(columns: Sequence[str]) -> str | None:
    return find_column(columns, "timestamp")


def audit_days(rows: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """One row per day: size, discovered columns, status and the columns with missing values.

    All counts come from one pass with partial aggregation.
    """
    label, ts = find_label_column(columns), find_timestamp_column(columns)
    missing = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"m_{i}") for i, c in enumerate(columns)]
    one = rows.groupBy(day).agg(F.count(F.lit(1)).alias("rows"), *missing)
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing"))
                       for i, c in enumerate(columns)])
    return one.select(
        day, "rows", F.lit(len(columns)).alias("columns"),
        F.lit(label).alias("label_column"), F.lit(ts).alias("timestamp_column"),
        F.lit("PASS" if label else "FAIL_NO_LABEL").alias("status"),
        F.filter(listed, lambda s: s["missing"] > 0).alias("missing_values"))


def missing_counts(audit: DataFrame, day: str) -> DataFrame:
    """Long form of the audit: one row per day and column with missing values."""
    return audit.select(day, "rows", "status", F.explode("missing_values").alias("m")).select(
        day, "rows", "status", "m.column", "m.missing")


def require_label(columns: Sequence[str], name: str = "frame") -> str:
    label = find_label_column(columns)
    if label is None:
        raise ValueError(f"no label column in {name}")
    return label


def attacks_per_day(rows: DataFrame, day: str = "day", target: str = "target") -> DataFrame:
    return rows.groupBy(day).agg(F.sum(F.col(target).cast("long")).alias("attacks"),
                                 F.count(F.lit(1)).alias("rows"))
