"""The given Parquet tables, and the views of them that the flow operators read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens import fixed_values as fv

FLOW_FEATURES = ("flow_duration", "flow_bytes", "packet_length", "syn_flag_count")
FLOW_TIES = ("l_orderkey", "l_linenumber", "l_partkey")
# separation and multiplier of each model's deterministic score
SCORE_MODELS = {"MAMBA_SSM": (0.60, 7919), "XGBoost": (0.45, 104729),
                "LightGBM": (0.30, 1299709), "CNN_BiLSTM": (0.15, 15485863)}
NOISE_MODEL = {"BiLSTM": (0.0, 7919)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as labelled flows; a day is one shipping year."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.year("l_shipdate").alias("day"), F.col("l_shipdate").alias("ts"),
        *FLOW_TIES, "l_suppkey",
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40), 1)
        .otherwise(0).alias("target"),
        F.col("l_quantity").alias("flow_duration"),
        F.col("l_extendedprice").alias("flow_bytes"),
        F.col("l_discount").alias("packet_length"),
        F.col("l_tax").alias("syn_flag_count"))


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as labelled flows; a day is a calendar day, errors are the attacks."""
    t = table(spark, sf_dir, "events")
    return t.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", "user_id",
        "event_type", (F.col("event_type") == "error").cast("int").alias("target"),
        "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def scores(spark: SparkSession, sf_dir: str, noise: bool = False) -> DataFrame:
    """Deterministic model scores on events: ``(split, event_id, model, y, p)``.

    The split is the per-day temporal one on every row.
    """
    from flowlens.operators.ordering import positional_index
    from flowlens.operators.windows import temporal_split

    indexed = positional_index(
        event_flows(spark, sf_dir).select("day", "ts", "event_id", "target"),
        ["day"], "ts", ["event_id"])
    rows = temporal_split(indexed).select("split", "event_id", F.col("target").alias("y"))
    return score_rows(rows, noise)


def score_rows(rows: DataFrame, noise: bool = False) -> DataFrame:
    models = dict(SCORE_MODELS, **(NOISE_MODEL if noise else {}))
    p = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), score_expr(s, k).alias("p"))
        for m, (s, k) in models.items()])).alias("m")
    return rows.select("*", p).select(*rows.columns, "m.model", "m.p")


def score_expr(separation: float, multiplier: int):
    residue = (F.col("event_id") * multiplier) % 1000
    return F.round(F.lit(separation) * F.col("y")
                   + F.lit(1.0 - separation) * residue / F.lit(1000.0), 6)


def incidents_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events read as detected incidents; one threat id in seven is not in the catalogue."""
    ids = [t[0] for t in fv.THREATS] + ["MITRE-T0000"]
    t = table(spark, sf_dir, "events").where("event_type = 'error'")
    return t.select(
        "event_id", "ts", F.format_string("10.0.%d.%d", F.floor(F.col("user_id") / 256),
                                          F.col("user_id") % 256).alias("src_ip"),
        F.element_at(F.array(*map(F.lit, ids)), (F.col("event_id") % 7 + 1).cast("int"))
        .alias("threat_id"),
        F.round((F.col("event_id") * 7919) % 1000 / F.lit(1000.0), 4).alias("probability"))


def actions_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up events read as operator actions on a source address, of which some had no incident."""
    t = table(spark, sf_dir, "events").where("event_type = 'signup'")
    verbs = F.array(F.lit("block"), F.lit("report"), F.lit("ignore"))
    user = F.col("user_id") * 2
    return t.select(
        F.col("event_id").alias("action_id"), "ts",
        F.format_string("10.0.%d.%d", F.floor(user / 256), user % 256).alias("src_ip"),
        F.element_at(verbs, (F.col("event_id") % 3 + 1).cast("int")).alias("action"))
