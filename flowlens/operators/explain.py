"""Scores of a differentiable window model and what each feature contributes to them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.numeric import sigmoid
from flowlens.functions.text import explain_query, render_rules
from flowlens.functions.vectors import let
from flowlens.operators.incidents import incident_numbers, verdict, with_threat
from flowlens.operators.retrieval import BlockIndex, hybrid_retrieve
from flowlens.operators.windows import STATISTICS, WINDOW_KEY, statistic_columns, vote
from flowlens.session import broadcast_if_small, stage
from flowlens.sources.requests import benign_response, detection_response


SALIENCY_DIGITS = 12


@dataclass(frozen=True)
class WindowModel:
    """Logistic model of a window: bias plus the mean over steps of ``w x + q x**2``."""

    bias: float
    linear: dict[str, float]
    square: dict[str, float]

    def logit(self) -> Column:
        out = F.lit(0.0)
        for f, w in self.linear.items():
            x = F.col(f)
            out = out + F.lit(w) * x + F.lit(self.square.get(f, 0.0)) * x * x
        return out

    def slope(self, f: str) -> Column:
        return F.abs(F.lit(self.linear[f]) + F.lit(2.0 * self.square.get(f, 0.0)) * F.col(f))


def score_windows(rows: DataFrame, model: WindowModel, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per window: label, probability and the saliency of every feature.

    Saliency is the mean over steps of ``|dp/dx|``; the derivative is closed-form, so score
    and saliency come out of the same aggregate. Saliency is rounded, so that features tied
    but for the order of summation rank by position.
    """
    steps = F.count(F.lit(1))
    out = rows.groupBy(*WINDOW_KEY).agg(
        vote(), F.avg(model.logit()).alias("_z"),
        *[(F.avg(model.slope(f)) / steps).alias(f"_s_{f}") for f in model.linear], *carry)
    p = sigmoid(F.lit(model.bias) + F.col("_z"))
    listed = F.array(*[
        F.struct(F.round(F.col("p") * (1.0 - F.col("p")) * F.col(f"_s_{f}"), SALIENCY_DIGITS)
                 .alias("importance"),
                 F.lit(i).alias("idx"), F.lit(f).alias("name"))
        for i, f in enumerate(model.linear)])
    out = out.withColumn("p", p).withColumn("saliency", listed)
    return out.drop("_z", *[f"_s_{f}" for f in model.linear])


def top_importances(saliency: Column, n: int = 5) -> Column:
    """Largest ``n`` features, scaled to sum 1 unless all are 0."""
    def share(top: Column) -> Column:
        total = F.aggregate(top, F.lit(0.0), lambda a, s: a + s["importance"])
        return let(total, lambda t: F.transform(top, lambda s: F.struct(
            s["name"].alias("name"),
            F.when(t > 0, s["importance"] / t).otherwise(s["importance"]).alias("importance"))))

    return let(F.slice(F.sort_array(saliency, asc=False), 1, n), share)


def name_importances(importances: DataFrame, key: Sequence[str], names: DataFrame) -> DataFrame:
    """``(key..., idx, name, importance)`` from an array; an index without a name is ``F<i>``."""
    long = importances.select(*key, F.posexplode("importance").alias("idx", "importance"))
    return long.join(F.broadcast(names), "idx", "left").select(
        *key, "idx", F.coalesce("name", F.concat(F.lit("F"), "idx")).alias("name"), "importance")


def pad_names(names: Sequence[str], width: int) -> list[str]:
    """Feature names up to ``width``, missing ones numbered."""
    return list(names) + [f"Feature_{i}" for i in range(len(names), width)]


def occlusion(stats: DataFrame, key: Sequence[str], features: Sequence[str], model,
              baseline: float = 0.0) -> DataFrame:
    """Importance for models without a derivative: ``|p - p(feature at its median)|``.

    Scaled features have median 0. Each window is scored once per feature in one transform;
    ``model`` is a fitted pipeline that assembles the statistics itself.
    """
    cells = statistic_columns(features)
    variants = [F.struct(F.lit(-1).alias("idx"), *[F.col(c) for c in cells])]
    for i, f in enumerate(features):
        gone = {f"{f}__{s}" for s in STATISTICS}
        variants.append(F.struct(F.lit(i).alias("idx"), *[
            (F.lit(0.0 if c.endswith("__std") else baseline) if c in gone else F.col(c)).alias(c)
            for c in cells]))
    long = stats.select(*key, F.explode(F.array(*variants)).alias("r")).select(*key, "r.*")
    scored = model.transform(long).select(
        *key, "idx", vector_to_array("probability")[1].alias("p"))
    name = F.element_at(F.array(*map(F.lit, features)), F.col("r.idx") + 1)
    wide = scored.groupBy(*key).agg(
        F.max(F.when(F.col("idx") == -1, F.col("p"))).alias("p"),
        F.collect_list(F.struct("idx", "p")).alias("_r"))
    return wide.select(*key, "p", F.explode(F.filter("_r", lambda r: r["idx"] >= 0)).alias("r")).select(
        *key, "p", F.col("r.idx").alias("idx"), name.alias("name"),
        F.abs(F.col("p") - F.col("r.p")).alias("importance"))


def detection_texts(scored: DataFrame, n: int = 3,
                    threshold: float = fv.DETECT_THRESHOLD) -> DataFrame:
    """Detected windows with their ``n`` top features and the query text made of these."""
    top = top_importances(F.col("saliency"), n)
    hits = scored.where(F.col("p") >= threshold).withColumn("top_features", top)
    return hits.withColumn("query_id", explain_query(F.transform("top_features", lambda s: s["name"])))


def explain_detections(scored: DataFrame, index: BlockIndex, catalogue: DataFrame,
                       n: int = 3, threshold: float = fv.DETECT_THRESHOLD) -> DataFrame:
    """Detected windows with top features, matching threat and hybrid score.

    Query texts are orderings of feature names, far fewer than windows: each distinct text
    is retrieved once and joined back.
    """
    hits = detection_texts(scored, n, threshold)
    texts = hits.select("query_id").distinct().withColumn("text", F.col("query_id"))
    found = hybrid_retrieve(texts, index).withColumnRenamed("doc_id", "idx")
    found = found.join(F.broadcast(catalogue.select("idx", "threat_id")), "idx").drop("idx")
    found = broadcast_if_small(stage(found, "matched-texts"))
    return hits.join(found, "query_id").withColumnRenamed("query_id", "query")


def detection_responses(scored: DataFrame, index: BlockIndex, catalogue: DataFrame, day: str, ts: str, ties: Sequence[str],
                        n: int = 5, threshold: float = fv.DETECT_THRESHOLD, start: int = 1) -> DataFrame:
    """Scored windows with ``response``, the JSON answer: a batch's incidents numbered, explained, matched, rendered.

    Detected windows are numbered from ``start`` in the order of time; their top features make the text that
    is matched with the catalogue, whose rules are filled with the window's ``src_ip``. Others get the verdict.
    """
    keep = [c for c in scored.columns if c != "saliency"]
    hits = explain_detections(scored, index, catalogue, n, threshold)
    hits = with_threat(incident_numbers(hits, day, ts, ties, start), catalogue)
    hits = hits.withColumns({"rules": render_rules(F.col("iptables"), F.col("src_ip")), "is_threat": F.lit(True),
                             "probability": F.round("p", 4), "_features": F.transform(
                                 "top_features", lambda s: F.struct(s["name"].alias("name"), s["importance"].alias("importance")))})
    answered = hits.drop("top_features").withColumnRenamed("_features", "top_features").select(
        *keep, "incident_id", detection_response().alias("response"))
    benign = scored.where(F.col("p") < threshold).withColumns(verdict(F.col("p"), threshold))
    return answered.unionByName(benign.select(*keep, F.lit(None).cast("string").alias("incident_id"),
                                              benign_response().alias("response")))
