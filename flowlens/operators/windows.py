"""Stride sampling, temporal split, fixed-length windows and what is computed inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens import fixed_values as fv
from flowlens.operators.ordering import positional_index

WINDOW_KEY = ("day", "split", "seq")
STATISTICS = ("last", "mean", "max", "min", "std")


def stride_sample(indexed: DataFrame, step: int = fv.SAMPLE_STEP) -> DataFrame:
    """Every ``step``-th row by position from 0; position and size are renumbered."""
    return (indexed.where(F.col("pos") % step == 0)
            .withColumns({"pos": F.floor(F.col("pos") / step),
                          "n": F.floor((F.col("n") + (step - 1)) / step)}))


def split_bounds() -> tuple[Column, Column]:
    """First positions of validation and test; products are taken in double, then cut."""
    n = F.col("n").cast("double")
    return ((n * F.lit(fv.TRAIN_END)).cast("long"),
            (n * F.lit(fv.VALIDATION_END)).cast("long"))


def temporal_split(indexed: DataFrame) -> DataFrame:
    """70/15/15 cut of every day by position; adds split, offset in it and its size."""
    first_val, first_test = split_bounds()
    out = indexed.withColumns({"_v": first_val, "_t": first_test})
    train, val = F.col("pos") < F.col("_v"), F.col("pos") < F.col("_t")
    return (out.withColumns({
        "split": F.when(train, "train").when(val, "val").otherwise("test"),
        "offset": F.col("pos") - F.when(train, 0).when(val, F.col("_v")).otherwise(F.col("_t")),
        "split_n": F.when(train, F.col("_v")).when(val, F.col("_t") - F.col("_v"))
        .otherwise(F.col("n") - F.col("_t"))}).drop("_v", "_t"))


def sequence_windows(split: DataFrame, length: int = fv.WINDOW_LENGTH) -> DataFrame:
    """Tumbling windows of ``length`` rows inside each (day, split); the short tail is dropped.

    Pure arithmetic on the offset: no further sort, no shuffle.
    """
    seq = F.floor(F.col("offset") / length)
    return (split.withColumns({"seq": seq, "step": F.col("offset") % length})
            .where((F.col("seq") + 1) * length <= F.col("split_n")))


def window_rows(rows: DataFrame, ties: Sequence[str], step: int = 1,
                length: int = fv.WINDOW_LENGTH) -> DataFrame:
    """Rows of all complete windows: index, split and window in one plan.

    Every row is used unless ``step`` asks for a stride.
    """
    indexed = positional_index(rows, ["day"], "ts", list(ties))
    kept = stride_sample(indexed, step) if step > 1 else indexed
    return sequence_windows(temporal_split(kept), length)


def vote(share: float = fv.WINDOW_ATTACK_SHARE) -> Column:
    return (F.avg("target") >= share).cast("int").alias("y")


def sequence_vote(rows: DataFrame, share: float = fv.WINDOW_ATTACK_SHARE) -> DataFrame:
    """Window label: attack if the mean target reaches ``share``."""
    return rows.groupBy(*WINDOW_KEY).agg(vote(share))


def sequences(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per window: ``x`` as an ordered array of feature arrays, and the label."""
    item = F.struct("step", F.array(*features).alias("v"))
    out = rows.groupBy(*WINDOW_KEY).agg(F.sort_array(F.collect_list(item)).alias("x"), vote())
    return out.withColumn("x", F.transform("x", lambda s: s["v"]))


def statistic_columns(features: Sequence[str]) -> list[str]:
    """Feature-major within statistic: all last values, then means, and so on."""
    return [f"{f}__{s}" for s in STATISTICS for f in features]


def window_stats(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Last, mean, max, min and population standard deviation per feature and window.

    However many features there are, the way is the same; nulls are as in ``window_table_stats``.
    """
    return window_table_stats(window_table(rows, features), features)


def window_table(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per window with one ordered array column per feature.

    The group is ``length`` rows by construction. What follows (statistics, scaling, scores)
    works inside the row.
    """
    item = F.struct("step", *[F.col(f"`{f}`") for f in features])
    out = rows.groupBy(*WINDOW_KEY).agg(F.sort_array(F.collect_list(item)).alias("_w"), vote())
    return out.select(*WINDOW_KEY, "y", *[F.col(f"_w.`{f}`").alias(f) for f in features])


def window_table_stats(table: DataFrame, features: Sequence[str],
                       keep: Sequence[str] = (*WINDOW_KEY, "y")) -> DataFrame:
    """The same statistics from a window table; no shuffle.

    The last value is that of the last step, null or not. The others are of the non-null values,
    and null if there are none.
    """
    # each step is a column of its own, as a lambda's input would be made again for every use of it
    values = {f: F.filter(F.col(f"`{f}`"), lambda v: v.isNotNull()) for f in features}
    kept = table.select(*keep, *[F.struct(
        F.element_at(F.col(f"`{f}`"), -1).alias("last"), values[f].alias("v")).alias(f"_{f}") for f in features])

    def mean(f: str) -> Column:
        v = F.col(f"`_{f}`.v")
        length = F.nullif(F.size(v), F.lit(0))
        return F.struct(length.alias("n"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / length).alias("mean"))

    kept = kept.select("*", *[mean(f).alias(f"_m_{f}") for f in features])

    def statistic(f: str, s: str) -> Column:
        v, n, m = F.col(f"`_{f}`.v"), F.col(f"`_m_{f}`.n"), F.col(f"`_m_{f}`.mean")
        if s in ("last", "mean"):
            return F.col(f"`_{f}`.last") if s == "last" else m
        if s == "std":
            return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)
        return F.array_max(v) if s == "max" else F.array_min(v)

    return kept.select(*keep, *[statistic(f, s).alias(f"{f}__{s}") for s in STATISTICS for f in features])


def window_table_rows(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Back to one row per step; no shuffle."""
    zipped = F.arrays_zip(*[F.col(f"`{f}`").alias(f) for f in features])
    return table.select(*WINDOW_KEY, "y", F.posexplode(zipped).alias("step", "_r")).select(
        *WINDOW_KEY, "y", "step", *[F.col(f"_r.`{f}`").alias(f) for f in features])


def window_table_steps(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Window table with ``x`` as an array of steps, each an array of features."""
    zipped = F.arrays_zip(*[F.col(f"`{f}`").alias(f) for f in features])
    return table.select(*WINDOW_KEY, "y", F.transform(
        zipped, lambda r: F.array(*[r[f] for f in features])).alias("x"))


def moving_kernel(feature: str, weights: Sequence[float]) -> Column:
    """Zero-padded width-3 kernel along the window, as a window expression on ``step``."""
    w = Window.partitionBy(*WINDOW_KEY).orderBy("step")
    left, middle, right = weights
    return (F.coalesce(F.lag(feature).over(w), F.lit(0.0)) * left + F.col(feature) * middle
            + F.coalesce(F.lead(feature).over(w), F.lit(0.0)) * right)


def linear_scan(values: Column, decay: float, gain: float) -> Column:
    """Recurrence ``h = h * decay + gain * u`` along an array; the state after the last step."""
    return F.aggregate(values, F.lit(0.0), lambda h, u: h * F.lit(decay) + F.lit(gain) * u)


def attention_pool(rows: DataFrame, score: Column, feature: str) -> DataFrame:
    """Softmax of ``score`` along the window as weights of a weighted mean of ``feature``.

    The exponent is shifted by the window maximum, so it cannot overflow.
    """
    s = rows.select(*WINDOW_KEY, score.alias("_s"), F.col(feature).alias("_f"))
    top = s.groupBy(*WINDOW_KEY).agg(
        F.max("_s").alias("_m"), F.collect_list(F.struct("_s", "_f")).alias("_w"))
    weight = F.transform("_w", lambda r: F.exp(r["_s"] - F.col("_m")))
    total = F.aggregate(weight, F.lit(0.0), lambda a, v: a + v)
    mixed = F.aggregate(F.zip_with(weight, "_w", lambda e, r: e * r["_f"]), F.lit(0.0),
                        lambda a, v: a + v)
    return top.select(*WINDOW_KEY, (mixed / total).alias("pooled"))


def split_summary(labels: DataFrame) -> DataFrame:
    """Windows and attack windows per split."""
    return labels.groupBy("split").agg(F.count(F.lit(1)).alias("windows"),
                                       F.sum("y").cast("long").alias("attacks"))


def align(x: DataFrame, y: DataFrame) -> DataFrame:
    """Features and labels held apart, joined on the window key instead of by position."""
    return x.join(y, list(WINDOW_KEY))


def union_days(days: Sequence[DataFrame]) -> DataFrame:
    """Day tables by column name; a column a day lacks becomes 0.0, as a missing value does."""
    if not days:
        raise ValueError("no day could be read")
    out = days[0]
    for d in days[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def require_splits(summary: DataFrame) -> None:
    """Stop if a split holds no window at all (three rows at most are read)."""
    have = {r["split"] for r in summary.collect()}
    missing = [s for s in ("train", "val", "test") if s not in have]
    if missing:
        raise ValueError(f"no complete window in: {', '.join(missing)}")
