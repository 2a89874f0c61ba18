"""Robust scaling: median and 5-95 % range of the train rows, then a clip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.operators.ordering import exact_quantiles


def melt(rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep..., feature, value)``; what is not a finite number is zero, as in scaling."""
    from flowlens.functions.numeric import finite_or_zero
    return rows.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 finite_or_zero(F.col(f"`{f}`").cast("double")).alias("value"))
        for f in features])).alias("r")).select(*keep, "r.feature", "r.value")


def robust_params(train: DataFrame, features: Sequence[str],
                  accuracy: int | None = None) -> DataFrame:
    """``(feature, median, low, high, scale)``; a zero range scales by 1.

    Exact by default. ``accuracy`` switches to the sketch, one pass, error 1/accuracy of
    the rank.
    """
    probs = (fv.SCALE_LOW, 0.5, fv.SCALE_HIGH)
    long = melt(train, features)
    if accuracy:
        q = F.percentile_approx("value", F.array(*map(F.lit, probs)), accuracy)
        params = long.groupBy("feature").agg(q.alias("q")).select(
            "feature", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"),
            F.col("q")[2].alias("high"))
    else:
        found = exact_quantiles(long, "feature", "value", probs)
        at = {p: F.max(F.when(F.col("prob") == p, F.col("q"))) for p in probs}
        params = found.groupBy("feature").agg(
            at[fv.SCALE_LOW].alias("low"), at[0.5].alias("median"),
            at[fv.SCALE_HIGH].alias("high"))
    width = F.col("high") - F.col("low")
    return params.select("feature", "median", "low", "high",
                         F.when(width == 0, 1.0).otherwise(width).alias("scale"))


def params_map(params: DataFrame) -> Column:
    """All parameters as one map-valued scalar subquery (one entry per feature)."""
    entry = F.struct("feature", F.struct("median", "scale"))
    return params.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def apply_robust_windows(table: DataFrame, features: Sequence[str],
                         params: dict[str, tuple[float, float]],
                         clip: float = fv.CLIP_TRAINING) -> DataFrame:
    """Scale the array columns of a window table in place."""
    from flowlens.functions.numeric import clip as clip_to, finite_or_zero

    def one(f: str) -> Column:
        median, scale = params[f]
        return F.transform(F.col(f"`{f}`"), lambda v: clip_to(
            (finite_or_zero(v) - F.lit(median)) / F.lit(scale), clip))

    return table.withColumns({f: one(f) for f in features})


def scaled(feature: str, median: Column, scale: Column, clip: float) -> Column:
    """Sanitised, centred, scaled and clipped. Sanitise first: a clip would keep NaN at +clip."""
    from flowlens.functions.numeric import clip as clip_to, finite_or_zero
    return clip_to((finite_or_zero(F.col(f"`{feature}`")) - median) / scale, clip)


def apply_robust(rows: DataFrame, features: Sequence[str], params: DataFrame,
                 clip: float = fv.CLIP_TRAINING) -> DataFrame:
    """Replace the features by their scaled values; parameters arrive as a scalar subquery."""
    p = params_map(params)
    withp = rows.withColumn("_p", p)
    return withp.withColumns({
        f: scaled(f, F.col("_p")[f]["median"], F.col("_p")[f]["scale"], clip)
        for f in features}).drop("_p")


def collect_params(params: DataFrame) -> dict[str, tuple[float, float]]:
    """Parameters as numbers: one row per feature is read."""
    return {r["feature"]: (r["median"], r["scale"]) for r in params.collect()}
