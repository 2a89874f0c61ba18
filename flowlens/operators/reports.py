"""Report tables: each page of the security report as a query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.numeric import ratio
from flowlens.functions.text import count_label, percent, rules_excerpt


def kpi_summary(counts: DataFrame, threat_types: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Key figures: threats raised, ROC, threat types seen, share and number of misses.

    ``counts`` is one row with tp, fp, tn, fn and roc_auc.
    """
    tp, fn = F.col("tp"), F.col("fn")
    return counts.select(
        (tp + F.col("fp")).alias("threats_detected"),
        (tp + F.col("fp") + F.col("tn") + fn).alias("samples"),
        F.round("roc_auc", 4).alias("roc_auc"),
        threat_types.agg(F.countDistinct("threat_id")).scalar().alias("threat_types"),
        catalogue.agg(F.count(F.lit(1))).scalar().alias("catalogue_size"),
        percent(ratio(fn.cast("double"), (fn + tp).cast("double"))).alias("fnr"),
        fn.alias("missed"))


def health_summary(threat_types: DataFrame, catalogue: DataFrame, length: int,
                   width: int) -> DataFrame:
    return threat_types.agg(F.countDistinct("threat_id").alias("threats_detected")).select(
        F.lit("healthy").alias("status"),
        catalogue.agg(F.count(F.lit(1))).scalar().alias("threats_in_kb"),
        "threats_detected", F.lit(length).alias("input_length"), F.lit(width).alias("input_width"))


def confusion_labels(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cell texts of the confusion figure."""
    return matrix.select(*by, "actual", "predicted",
                         count_label(F.col("n"), F.col("pct")).alias("label"))


def importance_labels(importances: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bar names cut to 20 characters, values to 4 decimals."""
    return importances.select(*key, F.substring("name", 1, 20).alias("name"),
                              F.format_string("%.4f", F.col("importance")).alias("value"))


def figure_bars(matrix: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long form of the bar figure, in percent."""
    long = matrix.unpivot(["model"], list(metrics), "metric", "value")
    return long.select("model", "metric", (F.col("value") * 100.0).alias("value"))


def threat_cards(rollup: DataFrame, catalogue: DataFrame, score: str) -> DataFrame:
    """Catalogue page: one card per detected threat."""
    full = rollup.join(F.broadcast(catalogue), "threat_id", "left")
    return full.select(
        "threat_id", "title", "tactic", "occurrences", F.round(score, 4).alias("score"),
        F.concat(F.substring("indicators", 1, 80), F.lit("...")).alias("indicators"))


def playbook_table(rollup: DataFrame, catalogue: DataFrame, src_ip: str = "0.0.0.0") -> DataFrame:
    """Playbook page: cut playbook text and the first response rules."""
    full = rollup.join(F.broadcast(catalogue), "threat_id", "left")
    return full.select(
        "threat_id", "title",
        F.concat(F.substring("playbook", 1, 90), F.lit("...")).alias("playbook"),
        rules_excerpt(F.col("iptables"), F.lit(src_ip)).alias("rules"), "occurrences")


def incident_sheet(incident_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Single-incident sheet: one ``(place, field, value)`` row per line."""
    lines = [("Threat", F.col("threat_name")), ("MITRE ATT&CK", F.col("threat_id")),
             ("Tactic", F.col("tactic")),
             ("Confidence", F.concat(F.format_string("%.1f", F.col("confidence")), F.lit("%"))),
             ("Source IP", F.col("src_ip")), ("Status", F.col("status")),
             ("Playbook", F.col("playbook")), ("Indicators", F.substring("indicators", 1, 300))]
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("field"),
                               v.alias("value")) for i, (n, v) in enumerate(lines)])
    return incident_rows.select(*key, F.explode(cells).alias("l")).select(*key, "l.*")
