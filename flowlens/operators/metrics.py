"""Binary classification metrics on a long table ``(by..., y, p)``; ``y`` is 0 or 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import ratio
from flowlens.operators.ordering import running_totals, score_bucket


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def confusion_counts(scores: DataFrame, by: Sequence[str], tau: str = "tau") -> DataFrame:
    """TP, FP, TN and FN of ``p >= tau`` per group; ``tau`` is a column of ``scores``."""
    hit, pos = F.col("p") >= F.col(tau), F.col("y") == 1
    return scores.groupBy(*by).agg(
        _count(hit & pos).alias("tp"), _count(hit & ~pos).alias("fp"),
        _count(~hit & ~pos).alias("tn"), _count(~hit & pos).alias("fn"))


def confusion_matrix(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Four rows per group ``(actual, predicted, n, pct)``, empty cells included."""
    cells = ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    cell = F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))
        for a, p, n in cells])).alias("c")
    negatives, positives = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    out = counts.select(*by, negatives.alias("_neg"), positives.alias("_pos"), cell)
    row = F.when(F.col("c.actual") == 1, F.col("_pos")).otherwise(F.col("_neg"))
    return out.select(*by, "c.actual", "c.predicted", "c.n",
                      (ratio(F.col("c.n"), row) * 100.0).alias("pct"))


def metric_columns() -> dict[str, Column]:
    """Metrics from the four counts; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "f2": ratio(5.0 * tp, 5.0 * tp + 4.0 * fn + fp),
        "mcc": ratio(tp * tn - fp * fn, spread),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }


def with_metrics(counts: DataFrame, digits: int = 4) -> DataFrame:
    return counts.withColumns({k: F.round(v, digits) for k, v in metric_columns().items()})


def score_points(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per distinct score, with counts at it, counts at or above it and totals.

    Scores are first collapsed to distinct values (partial aggregate), then summed from
    the top inside score buckets, so one model's scores never meet in one task.
    """
    points = scores.groupBy(*by, "p").agg(
        F.sum(F.col("y").cast("long")).alias("pos"),
        F.sum(1 - F.col("y").cast("long")).alias("neg"))
    points = points.withColumn("_bucket", score_bucket(F.col("p")))
    return running_totals(points, by, ["_bucket"], [F.desc("p")], {"tp": "pos", "fp": "neg"},
                          {"positives": "pos", "negatives": "neg"}, descending=True)


def auc_columns() -> dict[str, Column]:
    """Areas as aggregates over ``score_points``; null where only one class is present."""
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    all_pos = F.max("positives").cast("double")
    all_neg = F.max("negatives").cast("double")
    above = tp - pos
    before = above + (fp - neg)
    precision_before = F.when(before > 0, above / before).otherwise(1.0)
    return {
        "roc_auc": F.try_divide(F.sum(neg * (above + pos / 2.0)), all_pos * all_neg),
        "pr_auc": F.try_divide(F.sum(pos * (tp / (tp + fp) + precision_before) / 2.0), all_pos),
    }


def areas(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties count half) and trapezoidal PR-AUC anchored at (recall 0, precision 1)."""
    return score_points(scores, by).groupBy(*by).agg(
        *[v.alias(k) for k, v in auc_columns().items()])


def _anchor(points: DataFrame, by: Sequence[str], **values: float) -> DataFrame:
    return points.select(*by).distinct().select(
        *by, *[F.lit(v).alias(k) for k, v in values.items()])


def roc_curve(scores: DataFrame, by: Sequence[str], drop_collinear: bool = True) -> DataFrame:
    """``(by..., threshold, fpr, tpr)`` from (0, 0); inner points of straight runs are dropped.

    A point is inner if the next score adds the same counts. The next score of the last
    point in a bucket is the first point of the next bucket.
    """
    points = score_points(scores, by)
    if drop_collinear:
        key = [*by, "_bucket"]
        step = F.struct("pos", "neg")
        heads = points.groupBy(*key).agg(F.max_by(step, "p").alias("_head"))
        after = Window.partitionBy(*by).orderBy(F.desc("_bucket")) if by else \
            Window.partitionBy(F.lit(0)).orderBy(F.desc("_bucket"))
        heads = heads.withColumn("_next_head", F.lead("_head").over(after)).drop("_head")
        inside = Window.partitionBy(*key).orderBy(F.desc("p"))
        points = (points.withColumn("_next", F.lead(step).over(inside))
                  .join(heads, key)
                  .withColumn("_next", F.coalesce("_next", "_next_head")))
        first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
        points = points.where(first | F.col("_next").isNull() | (F.col("_next") != step))
    curve = points.select(*by, F.col("p").alias("threshold"),
                          (F.col("fp") / F.col("negatives")).alias("fpr"),
                          (F.col("tp") / F.col("positives")).alias("tpr"))
    return curve.unionByName(_anchor(curve, by, threshold=float("inf"), fpr=0.0, tpr=0.0))


def pr_curve(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by..., threshold, recall, precision)``, one row per distinct score and the anchor."""
    points = score_points(scores, by)
    curve = points.select(*by, F.col("p").alias("threshold"),
                          (F.col("tp") / F.col("positives")).alias("recall"),
                          (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return curve.unionByName(_anchor(curve, by, threshold=float("inf"), recall=0.0,
                                     precision=1.0))
