"""Which columns may become features, and which of them carry information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv


def allowed_columns(columns: Sequence[str], also_drop: Sequence[str] = ()) -> list[str]:
    """Columns outside the ban list (exact lower-case names) and outside ``also_drop``.

    ``also_drop`` takes the discovered label and time columns: discovery matches a part of
    the name, so they need not be on the list.
    """
    gone = {c.lower() for c in also_drop} | set(fv.BANNED_COLUMNS)
    return [c for c in columns if c.lower() not in gone]


def except_names(names: DataFrame, banned: DataFrame) -> DataFrame:
    """Row form of the same set difference."""
    return names.exceptAll(banned)


def varies(std: Column, eps: float = fv.MIN_FEATURE_STD) -> Column:
    """True if the deviation is a number above ``eps``; NaN (an Inf in train) is not."""
    return ~F.isnan(std) & (std > eps)


def feature_deviation(train: DataFrame, features: Sequence[str],
                      eps: float = fv.MIN_FEATURE_STD) -> DataFrame:
    """Population deviation per feature over the train rows: ``(feature, std, kept)``."""
    one = train.agg(*[F.stddev_pop(f).alias(f) for f in features])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("std")) for f in features]))
        .alias("r")).select("r.*")
    return rows.withColumn("kept", F.coalesce(varies(F.col("std"), eps), F.lit(False)))


def kept_features(train: DataFrame, features: Sequence[str],
                  eps: float = fv.MIN_FEATURE_STD) -> list[str]:
    """Names that vary in train, in input order (one row is read)."""
    if not features:
        return []
    row = train.agg(*[F.coalesce(varies(F.stddev_pop(F.col(f"`{f}`")), eps), F.lit(False))
                      for f in features]).first()
    return [f for f, keep in zip(features, row) if keep]
