"""The threat catalogue: a dimension of six rows, joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens import fixed_values as fv

SCHEMA = T.StructType([
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("threat_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("tactic", T.StringType(), False),
    T.StructField("keywords", T.StringType(), False),
    T.StructField("playbook", T.StringType(), False),
    T.StructField("iptables", T.ArrayType(T.StringType()), False),
    T.StructField("indicators", T.StringType(), False),
])


def threat_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(i, *t[:5], list(t[5]), t[6]) for i, t in enumerate(fv.THREATS)]
    return spark.createDataFrame(rows, SCHEMA)


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.DISPLAY_NAMES.items()), "threat_id string, display string")


def catalogue_text(catalogue: DataFrame) -> DataFrame:
    """Retrieval text of each threat."""
    return catalogue.select(F.col("idx").alias("doc_id"),
                            F.concat_ws(" ", "title", "keywords", "playbook").alias("text"))
