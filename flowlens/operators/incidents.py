"""From scored windows to incident records, actions on them and their roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.text import render_rules
from flowlens.operators.ordering import global_index
from flowlens.session import broadcast_if_small


def verdict(p: Column, threshold: float = fv.DETECT_THRESHOLD) -> dict[str, Column]:
    """Detection fields; a benign row has the verdict and nothing further."""
    threat = p >= threshold
    return {"is_threat": threat, "probability": F.round(p, 4),
            "verdict": F.when(~threat, F.lit("BENIGN"))}


def with_threat(detections: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue fields by threat id; null where the catalogue lacks it, so no detection is lost."""
    fields = catalogue.select("threat_id", "title", "tactic", "playbook", "indicators", "iptables")
    return detections.join(broadcast_if_small(fields), "threat_id", "left")


def with_display_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Display name by threat id, the catalogue title where there is none."""
    return (rows.join(broadcast_if_small(names), "threat_id", "left")
            .withColumn("threat_name", F.coalesce("display", "title")).drop("display"))


def incident_fields(p: Column, status: str = fv.STATUS_DETECTED) -> dict[str, Column]:
    return {"confidence": F.round(p * 100.0, 1), "probability": F.round(p, 4),
            "status": F.lit(status)}


def incidents(detections: DataFrame, catalogue: DataFrame, names: DataFrame) -> DataFrame:
    """Incident records; ``detections`` needs threat_id, src_ip and p."""
    full = with_display_name(with_threat(detections, catalogue), names)
    return full.withColumns({**incident_fields(F.col("p")),
                             "rules": render_rules(F.col("iptables"), F.col("src_ip"))})


def incident_numbers(rows: DataFrame, day: str, ts: str, ties: Sequence[str],
                     start: int = 1) -> DataFrame:
    """Numbered incidents in time order over all days."""
    indexed = global_index(rows, day, ts, ties, pos="_n")
    number = (F.col("_n") + start).cast("long")
    return indexed.withColumn("incident_id",
                              F.format_string(fv.INCIDENT_ID_FORMAT, number)).drop("_n")


def registry(incident_rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Active incident per source: the last one wins.

    ``max_by`` aggregates before the shuffle, so a source with very many incidents sends
    one row per task.
    """
    rest = [c for c in incident_rows.columns if c != "src_ip"]
    return incident_rows.groupBy("src_ip").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("i")).select("src_ip", "i.*")


def block_rule(src_ip: Column) -> Column:
    return F.replace(F.lit(fv.BLOCK_RULE), F.lit("{src_ip}"), src_ip)


def apply_actions(actions: DataFrame, active: DataFrame) -> DataFrame:
    """Operator actions against the registry: new status, rule text and whether it was found.

    The registry has one row per source; a source with many actions is split by adaptive
    skew handling.
    """
    hit = actions.join(active.select("src_ip", "threat_id", F.lit(True).alias("found")),
                       "src_ip", "left")
    found = F.coalesce("found", F.lit(False))
    blocked = F.col("action") == "block"
    status = F.when(found & blocked, fv.STATUS_BLOCKED).when(found, fv.STATUS_DETECTED)
    return hit.withColumns({"found": found, "status": status,
                            "rule": F.when(blocked, block_rule(F.col("src_ip")))})


def threat_rollup(detections: DataFrame, order: Sequence[str], score: str) -> DataFrame:
    """Detections per threat with the score of the first one."""
    return detections.groupBy("threat_id").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by(score, F.struct(*order)).alias(score))


def catalogue_flags(catalogue: DataFrame, detected: DataFrame) -> DataFrame:
    """Whole catalogue with DETECTED or a dash."""
    seen = detected.select("threat_id").distinct().withColumn("_seen", F.lit(True))
    return catalogue.join(seen, "threat_id", "left").select(
        "threat_id", "title", F.when(F.col("_seen"), fv.STATUS_DETECTED).otherwise("—").alias("flag"))


def undetected(catalogue: DataFrame, detected: DataFrame) -> DataFrame:
    return catalogue.join(detected.select("threat_id").distinct(), "threat_id", "left_anti").select(
        "threat_id", "title")
