"""Detection requests as JSON: defaults, validation and the response body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv

REQUEST_SCHEMA = ("features array<array<double>>, src_ip string, dst_port int, protocol string")


def parse_requests(raw: DataFrame, body: str = "value") -> DataFrame:
    """Typed request columns; absent fields take their defaults."""
    r = F.from_json(body, REQUEST_SCHEMA)
    out = raw.withColumn("_r", r)
    return out.select(
        *raw.columns, F.col("_r.features").alias("features"),
        F.coalesce("_r.src_ip", F.lit(fv.DEFAULT_SRC_IP)).alias("src_ip"),
        F.coalesce("_r.dst_port", F.lit(fv.DEFAULT_DST_PORT)).alias("dst_port"),
        F.coalesce("_r.protocol", F.lit(fv.DEFAULT_PROTOCOL)).alias("protocol"))


def request_error(length: int, width: int) -> Column:
    """Why a request cannot be scored, or null."""
    x = F.col("features")
    complete = F.forall(x, lambda row: row.isNotNull() & (F.size(row) == width)
                        & F.forall(row, lambda v: v.isNotNull()))
    return (F.when(x.isNull(), "features are not a numeric matrix")
            .when(F.size(x) != length, "wrong number of steps")
            .when(~complete, "wrong number of features or a value that is not a number"))


def split_requests(requests: DataFrame, length: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Requests to score and requests to answer with an error; the good ones go on."""
    marked = requests.withColumn("error", request_error(length, width))
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def benign_response() -> Column:
    """Response without a threat: the detection and the verdict."""
    return F.to_json(F.struct(F.struct("is_threat", "probability").alias("detection"), F.lit("BENIGN").alias("verdict")))


def detection_response() -> Column:
    """Nested response as JSON; a benign row carries only the verdict."""
    detection = F.struct("is_threat", "probability")
    threat = F.to_json(F.struct(
        "incident_id", detection.alias("detection"),
        F.struct(F.col("threat_id").alias("id"), "title", "tactic", "indicators", "playbook")
        .alias("threat"),
        F.struct("top_features").alias("xai"),
        F.struct(F.round("hybrid_score", 4).alias("hybrid_score")).alias("rag"),
        F.struct(F.col("rules").alias("iptables")).alias("response")))
    return F.when(F.col("is_threat"), threat).otherwise(benign_response())
