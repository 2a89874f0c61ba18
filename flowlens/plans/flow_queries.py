"""Queries on flows and events: cleaning, time order, windows, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.numeric import (binary_target, clip, finite_or_zero,
                                        finite_or_zero_array, sigmoid, softmax_positive,
                                        to_number)
from flowlens.functions.timeparse import parse_time
from flowlens.operators import explain, quality, selection, windows as W
from flowlens.operators.incidents import verdict
from flowlens.operators.ordering import exact_quantiles, positional_index
from flowlens.operators.scaling import apply_robust, robust_params
from flowlens.plans.detect import scaled_windows
from flowlens.plans.registry import query, with_ctes
from flowlens.session import stage
from flowlens.sources.tables import FLOW_FEATURES, FLOW_TIES, event_flows, flows, table

KEY = list(W.WINDOW_KEY)
LINE = list(FLOW_TIES)

FLOWS = """flows AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS day, l_shipdate AS ts, l_orderkey, l_linenumber,
         l_partkey, l_suppkey,
         CASE WHEN l_returnflag = 'R' AND l_quantity >= 40 THEN 1 ELSE 0 END AS target,
         l_quantity AS flow_duration, l_extendedprice AS flow_bytes,
         l_discount AS packet_length, l_tax AS syn_flag_count
  FROM lineitem)"""
POSITIONS = """positions AS (
  SELECT *, row_number() OVER (PARTITION BY day
            ORDER BY ts, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
         count(*) OVER (PARTITION BY day) AS n
  FROM flows)"""
STRIDED = """strided AS (
  SELECT * EXCLUDE (pos, n), pos // 5 AS pos, (n + 4) // 5 AS n
  FROM positions WHERE pos % 5 = 0)"""


def split_sql(source: str) -> str:
    return f"""marked AS (
  SELECT *, CAST(trunc(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS v,
         CAST(trunc(n * CAST(0.85 AS DOUBLE)) AS BIGINT) AS t FROM {source}),
parted AS (
  SELECT *, CASE WHEN pos < v THEN 'train' WHEN pos < t THEN 'val' ELSE 'test' END AS split,
         pos - CASE WHEN pos < v THEN 0 WHEN pos < t THEN v ELSE t END AS off,
         CASE WHEN pos < v THEN v WHEN pos < t THEN t - v ELSE n - t END AS split_n
  FROM marked)"""


WIN = """win AS (
  SELECT *, off // 10 AS seq, off % 10 AS step FROM parted
  WHERE (off // 10 + 1) * 10 <= split_n)"""
WINDOWED = (FLOWS, POSITIONS, split_sql("positions"), WIN)
EVENT_FLOWS = """ev AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, ts, event_id, user_id, event_type,
         CAST(event_type = 'error' AS INTEGER) AS target, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""
EVENT_POSITIONS = """evpos AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY day) AS n FROM ev)"""
PARAMS = "params AS (\n" + "\nUNION ALL\n".join(
    f"""  SELECT '{f}' AS feature, quantile_cont({f}, 0.5) AS median,
         quantile_cont({f}, 0.05) AS low, quantile_cont({f}, 0.95) AS high
  FROM win WHERE split = 'train'""" for f in FLOW_FEATURES) + ")"
SCALES = """scales AS (
  SELECT *, CASE WHEN high = low THEN 1.0 ELSE high - low END AS scale FROM params)"""


def scaled_sql(f: str, clip_at: float) -> str:
    return (f"greatest(-{clip_at}, least({clip_at}, ({f} - (SELECT median FROM scales WHERE "
            f"feature = '{f}')) / (SELECT scale FROM scales WHERE feature = '{f}')))")




def scaled_cte(clip_at: float) -> str:
    return ("scaled AS (SELECT * EXCLUDE (" + ", ".join(FLOW_FEATURES) + "), "
            + ", ".join(f"{scaled_sql(f, clip_at)} AS {f}" for f in FLOW_FEATURES) + " FROM win)")


SCALED = scaled_cte(fv.CLIP_TRAINING)

# fixed scoring model on scaled features; its weights are this repository's own
MODEL = explain.WindowModel(
    bias=-3.1,
    linear={"flow_duration": 13.2, "flow_bytes": 7.2, "packet_length": -4.8,
            "syn_flag_count": 3.6},
    square={"flow_duration": 6.0, "flow_bytes": -3.6, "packet_length": 7.2,
            "syn_flag_count": 4.8})


def model_sql() -> str:
    terms = " + ".join(
        f"CAST({MODEL.linear[f]} AS DOUBLE) * {f} + CAST({MODEL.square[f]} AS DOUBLE) * {f} * {f}"
        for f in FLOW_FEATURES)
    slopes = ", ".join(
        f"avg(abs(CAST({MODEL.linear[f]} AS DOUBLE) + CAST({2 * MODEL.square[f]} AS DOUBLE)"
        f" * {f})) / 10.0 AS s_{f}" for f in FLOW_FEATURES)
    return f"""scored AS (
  SELECT day, split, seq, CAST(avg(target) >= 0.2 AS INTEGER) AS y,
         1.0 / (1.0 + exp(-(CAST({MODEL.bias} AS DOUBLE) + avg({terms})))) AS p, {slopes},
         min(l_suppkey) AS l_suppkey
  FROM scaled GROUP BY day, split, seq)"""


def scored_flows(spark: SparkSession, sf_dir: str, carry=(),
                 clip_at: float = fv.CLIP_TRAINING) -> DataFrame:
    """Windows of flows scored by the fixed model, with saliency."""
    done = scaled_windows(flows(spark, sf_dir), FLOW_FEATURES, FLOW_TIES, clip_at)
    return explain.score_windows(done.scaled, MODEL, carry)


@query("flow_detections", with_ctes(*WINDOWED, PARAMS, SCALES, SCALED, model_sql(), body="""
SELECT day, split, count(*) AS windows, CAST(sum(y) AS BIGINT) AS attacks,
       CAST(sum(CASE WHEN round(p, 6) >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS detected,
       CAST(sum(CASE WHEN round(p, 6) >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       round(avg(p), 6) AS mean_p
FROM scored GROUP BY day, split"""))
def flow_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per day and split: index, stride, split, windows, scaling, score, verdict."""
    scored = scored_flows(spark, sf_dir)
    hit = verdict(F.round("p", 6), 0.5)["is_threat"]
    return scored.groupBy("day", "split").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("y").cast("long")).alias("attacks"),
        F.sum(hit.cast("long")).alias("detected"),
        F.sum((hit & (F.col("y") == 1)).cast("long")).alias("hits"),
        F.round(F.avg("p"), 6).alias("mean_p"))


# ---------------------------------------------------------------- audit and cleaning

AUDIT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "Label quality", "Label toxic")


@query("day_audit", """
WITH a AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source AS day, count(*) AS rows, 7 AS columns, 'Label quality' AS label_column,
       'PASS' AS status,
       concat_ws(';',
         CASE WHEN count(*) > count(text) THEN 'text:' || (count(*) - count(text)) END,
         CASE WHEN count(*) > count(lang) THEN 'lang:' || (count(*) - count(lang)) END,
         CASE WHEN count(*) > count(source) THEN 'source:' || (count(*) - count(source)) END,
         CASE WHEN count(*) > count(n_chars) THEN 'n_chars:' || (count(*) - count(n_chars)) END,
         CASE WHEN count(*) > count(quality)
              THEN 'Label quality:' || (count(*) - count(quality)) END,
         CASE WHEN count(*) > count(toxic)
              THEN 'Label toxic:' || (count(*) - count(toxic)) END) AS missing
FROM a GROUP BY source""")
def day_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select(F.col("source").alias("day"), "doc_id", "text", "lang", "source", "n_chars",
                       F.col("quality").alias("Label quality"), F.col("toxic").alias("Label toxic"))
    audit = quality.audit_days(rows, "day", AUDIT_COLUMNS)
    shown = F.transform("missing_values", lambda m: F.concat_ws(":", m["column"], m["missing"]))
    return audit.select("day", "rows", "columns", "label_column", "status",
                        F.array_join(shown, ";").alias("missing"))


@query("missing_by_column", """
WITH a AS (SELECT d.source AS day, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT day, count(*) AS rows, 'Label quality' AS "column",
             count(*) - count(quality) AS missing FROM a GROUP BY day
      UNION ALL
      SELECT day, count(*), 'Label toxic', count(*) - count(toxic) FROM a GROUP BY day)
SELECT day, rows, 'PASS' AS status, "column", missing FROM m WHERE missing > 0""")
def missing_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select(F.col("source").alias("day"), F.col("quality").alias("Label quality"),
                       F.col("toxic").alias("Label toxic"))
    return quality.missing_counts(
        quality.audit_days(rows, "day", ("Label quality", "Label toxic")), "day")


@query("parse_dayfirst", """
WITH raw AS (SELECT event_id, CASE event_id % 10
         WHEN 0 THEN 'Timestamp' WHEN 1 THEN '' WHEN 2 THEN '2024-13-45 99:00:00'
         ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS t FROM events)
SELECT event_id, strftime(try_strptime(t, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed
FROM raw WHERE try_strptime(t, '%d/%m/%Y %H:%M:%S') IS NOT NULL""")
def parse_dayfirst(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 10
    text = (F.when(kind == 0, "Timestamp").when(kind == 1, "")
            .when(kind == 2, "2024-13-45 99:00:00")
            .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")))
    raw = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    parsed = raw.select("event_id", parse_time(F.col("t"), "d/M/yyyy H:mm:ss").alias("ts_parsed"))
    return parsed.dropna(subset=["ts_parsed"]).select(
        "event_id", F.date_format("ts_parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("binary_target", """
WITH raw AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' BENIGN ' WHEN 1 THEN 'Benign'
         WHEN 2 THEN NULL WHEN 3 THEN 'benign' WHEN 4 THEN event_type ELSE 'DoS ' END AS label
         FROM events)
SELECT event_id, CASE WHEN trim(lower(label)) = 'benign' THEN 0 ELSE 1 END AS target FROM raw""")
def binary_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 6
    label = (F.when(kind == 0, " BENIGN ").when(kind == 1, "Benign")
             .when(kind == 2, F.lit(None).cast("string")).when(kind == 3, "benign")
             .when(kind == 4, F.col("event_type")).otherwise("DoS "))
    return table(spark, sf_dir, "events").select("event_id", binary_target(label).alias("target"))


@query("coerce_numeric", """
WITH raw AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN CAST(value AS VARCHAR)
         WHEN 1 THEN ' ' || CAST(value AS VARCHAR) || ' ' WHEN 2 THEN 'abc' WHEN 3 THEN ''
         WHEN 4 THEN NULL WHEN 5 THEN 'Infinity' WHEN 6 THEN '-inf' WHEN 7 THEN 'NaN'
         ELSE CAST(value AS VARCHAR) || 'd' END AS t FROM events),
num AS (SELECT event_id, TRY_CAST(t AS DOUBLE) AS x FROM raw),
clean AS (SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE x END AS x FROM num)
SELECT event_id, CASE WHEN isinf(x) THEN CASE WHEN x > 0 THEN 'inf' ELSE '-inf' END
       ELSE 'finite' END AS kind, CASE WHEN isinf(x) THEN 0.0 ELSE x END AS x FROM clean""")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_id") % 9, F.col("value").cast("string")
    text = (F.when(kind == 0, value).when(kind == 1, F.concat(F.lit(" "), value, F.lit(" ")))
            .when(kind == 2, "abc").when(kind == 3, "").when(kind == 4, F.lit(None).cast("string"))
            .when(kind == 5, "Infinity").when(kind == 6, "-inf").when(kind == 7, "NaN")
            .otherwise(F.concat(value, F.lit("d"))))
    x = table(spark, sf_dir, "events").select("event_id", to_number(text).alias("x"))
    shown = (F.when(F.col("x") == float("inf"), "inf").when(F.col("x") == float("-inf"), "-inf")
             .otherwise("finite"))
    return x.select("event_id", shown.alias("kind"), finite_or_zero(F.col("x")).alias("x"))


@query("sanitize_nonfinite", """
SELECT event_id, value + CASE WHEN event_id % 4 = 0 THEN k ELSE 0.0 END AS total
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def sanitize_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays holding NaN and infinities, zeroed, then added up."""
    kind = F.col("event_id") % 4
    second = (F.when(kind == 0, F.col("k")).when(kind == 1, F.lit(float("nan")))
              .when(kind == 2, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    rows = event_flows(spark, sf_dir).select(
        "event_id", finite_or_zero_array(F.array("value", second)).alias("a"))
    return rows.select("event_id", (F.col("a")[0] + F.col("a")[1]).alias("total"))


@query("except_names", """
SELECT DISTINCT replace(event_type, 'signup', 'Label') AS name FROM events
WHERE lower(replace(event_type, 'signup', 'Label')) NOT IN ('label', 'protocol')""")
def except_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names found in the data, less the banned ones, as a row-level set difference."""
    name = F.replace("event_type", F.lit("signup"), F.lit("Label")).alias("name")
    found = table(spark, sf_dir, "events").select(name).distinct()
    banned = found.where(F.lower("name").isin(*fv.BANNED_COLUMNS))
    return selection.except_names(found, banned)


# ---------------------------------------------------------------- time order and windows

@query("day_position", with_ctes(FLOWS, POSITIONS, body="""
SELECT day, l_orderkey, l_linenumber, l_partkey, pos, n FROM positions"""))
def day_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index(flows(spark, sf_dir), ["day"], "ts", LINE).select(
        "day", *LINE, "pos", "n")


@query("stride_sample", with_ctes(FLOWS, POSITIONS, STRIDED, body="""
SELECT day, l_orderkey, l_linenumber, l_partkey, pos, n FROM strided"""))
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = positional_index(flows(spark, sf_dir), ["day"], "ts", LINE)
    return W.stride_sample(indexed).select("day", *LINE, "pos", "n")


@query("temporal_split", with_ctes(EVENT_FLOWS, EVENT_POSITIONS, split_sql("evpos"), body="""
SELECT day, event_id, split, off AS "offset", split_n FROM parted"""))
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = positional_index(event_flows(spark, sf_dir).select("day", "ts", "event_id"),
                               ["day"], "ts", ["event_id"])
    return W.temporal_split(indexed).select("day", "event_id", "split", "offset", "split_n")


@query("sequence_windows", with_ctes(*WINDOWED, body="""
SELECT day, split, seq, step, l_orderkey, l_linenumber, l_partkey FROM win"""))
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_rows(flows(spark, sf_dir), LINE).select(*KEY, "step", *LINE)


@query("sequence_vote", with_ctes(*WINDOWED, body="""
SELECT day, split, seq, CAST(avg(target) >= 0.2 AS INTEGER) AS y FROM win
GROUP BY day, split, seq"""))
def sequence_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sequence_vote(W.window_rows(flows(spark, sf_dir), LINE))


@query("attacks_per_day", with_ctes(FLOWS, body="""
SELECT day, CAST(sum(target) AS BIGINT) AS attacks, count(*) AS rows FROM flows GROUP BY day"""))
def attacks_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.attacks_per_day(flows(spark, sf_dir))


@query("window_stats", with_ctes(*WINDOWED, body="SELECT day, split, seq, "
       "CAST(avg(target) >= 0.2 AS INTEGER) AS y, "
       + ", ".join(f"max_by({f}, step) AS {f}__last, round(avg({f}), 4) AS {f}__mean, "
                   f"max({f}) AS {f}__max, min({f}) AS {f}__min, "
                   f"round(stddev_pop({f}), 4) AS {f}__std" for f in FLOW_FEATURES)
       + " FROM win GROUP BY day, split, seq"))
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = W.window_stats(W.window_rows(flows(spark, sf_dir), LINE), FLOW_FEATURES)
    return stats.select(*KEY, "y", *[
        (F.round(c, 4) if c.endswith(("__mean", "__std")) else F.col(c)).alias(c)
        for c in W.statistic_columns(FLOW_FEATURES)])


@query("split_summary", with_ctes(*WINDOWED, body="""
, v AS (SELECT day, split, seq, CAST(avg(target) >= 0.2 AS INTEGER) AS y FROM win
        GROUP BY day, split, seq)
SELECT split, count(*) AS windows, CAST(sum(y) AS BIGINT) AS attacks FROM v GROUP BY split"""))
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.split_summary(W.sequence_vote(W.window_rows(flows(spark, sf_dir), LINE)))


@query("zero_variance", with_ctes(*WINDOWED, """tr AS (
  SELECT *, 1.0 AS constant, CASE WHEN syn_flag_count = 0 THEN 1 ELSE 0 END AS bad
  FROM win WHERE split = 'train')""", body="""
SELECT 'flow_duration' AS feature, round(stddev_pop(flow_duration), 4) AS std,
       stddev_pop(flow_duration) > 1e-5 AS kept FROM tr
UNION ALL SELECT 'flow_bytes', round(stddev_pop(flow_bytes), 4), stddev_pop(flow_bytes) > 1e-5 FROM tr
UNION ALL SELECT 'packet_length', round(stddev_pop(packet_length), 4),
       stddev_pop(packet_length) > 1e-5 FROM tr
UNION ALL SELECT 'constant', round(stddev_pop(constant), 4), stddev_pop(constant) > 1e-5 FROM tr
UNION ALL SELECT 'rate', -1.0, max(bad) = 0 FROM tr"""))
def zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rate`` holds infinities, so its deviation is NaN and it is dropped."""
    rows = W.window_rows(flows(spark, sf_dir), LINE).where("split = 'train'")
    rate = F.when(F.col("syn_flag_count") == 0, float("inf")).otherwise(
        F.col("flow_bytes") / F.col("syn_flag_count"))
    rows = rows.withColumns({"constant": F.lit(1.0), "rate": rate})
    out = selection.feature_deviation(
        rows, ["flow_duration", "flow_bytes", "packet_length", "constant", "rate"])
    shown = F.when(F.isnan("std"), F.lit(-1.0)).otherwise(F.round("std", 4))
    return out.select("feature", shown.alias("std"), "kept")


@query("robust_params", with_ctes(*WINDOWED, PARAMS + """,
dirty AS (SELECT CASE WHEN syn_flag_count = 0 OR packet_length = 0 THEN 0.0
                      ELSE flow_bytes / syn_flag_count END AS rate FROM win WHERE split = 'train'),
all_params AS (SELECT * FROM params UNION ALL
  SELECT 'rate', quantile_cont(rate, 0.5), quantile_cont(rate, 0.05), quantile_cont(rate, 0.95)
  FROM dirty)""", SCALES.replace("FROM params", "FROM all_params"), body="""
SELECT feature, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high,
       round(scale, 6) AS scale FROM scales"""))
def robust_params_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rate`` holds infinities and NaN, which count as zero."""
    rate = F.when(F.col("syn_flag_count") == 0, float("inf")).when(
        F.col("packet_length") == 0, float("nan")).otherwise(
        F.col("flow_bytes") / F.col("syn_flag_count"))
    train = stage(W.window_rows(flows(spark, sf_dir), LINE).where("split = 'train'")
                  .select(*FLOW_FEATURES, rate.alias("rate")), "train")
    return robust_params(train, [*FLOW_FEATURES, "rate"]).select(
        "feature", *[F.round(c, 6).alias(c) for c in ("median", "low", "high", "scale")])


@query("robust_scale_apply", with_ctes(*WINDOWED, PARAMS, SCALES, SCALED, body=(
    "SELECT day, split, seq, step, "
    + ", ".join(f"round({f}, 6) AS {f}" for f in FLOW_FEATURES)
    + " FROM scaled WHERE split <> 'train'")))
def robust_scale_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of train rows applied to validation and test rows."""
    done = scaled_windows(flows(spark, sf_dir), FLOW_FEATURES, FLOW_TIES)
    return done.scaled.where("split <> 'train'").select(
        *KEY, "step", *[F.round(f, 6).alias(f) for f in FLOW_FEATURES])


@query("clip_scaled", """
WITH q AS (SELECT quantile_cont(value, 0.5) AS m,
                  quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS w FROM events),
z AS (SELECT event_id, (value * 10 - q.m) / q.w AS z FROM events, q)
SELECT event_id, round(greatest(-6.0, least(6.0, z)), 6) AS training,
       round(greatest(-15.0, least(15.0, z)), 6) AS serving FROM z""")
def clip_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both clip bounds on values ten times outside the fitted range."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    params = robust_params(rows, ["value"])
    wide = rows.withColumn("value", F.col("value") * 10)
    training = apply_robust(wide, ["value"], params, fv.CLIP_TRAINING)
    serving = apply_robust(wide, ["value"], params, fv.CLIP_SERVING)
    return training.select("event_id", F.round("value", 6).alias("training")).join(
        serving.select("event_id", F.round("value", 6).alias("serving")), "event_id")


@query("event_quantiles", """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS low,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS high
FROM events GROUP BY event_type""")
def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated quantiles per group."""
    found = exact_quantiles(table(spark, sf_dir, "events"), "event_type", "value",
                            (0.05, 0.5, 0.95))
    return found.groupBy("event_type").agg(*[
        F.round(F.max(F.when(F.col("prob") == p, F.col("q"))), 6).alias(n)
        for p, n in ((0.05, "low"), (0.5, "median"), (0.95, "high"))])


@query("union_days", with_ctes(FLOWS, body="""
SELECT day, count(*) AS rows, round(sum(flow_duration), 2) AS flow_duration,
       round(sum(CASE WHEN day % 2 = 0 THEN flow_bytes ELSE 0.0 END), 2) AS flow_bytes
FROM flows GROUP BY day"""))
def union_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd days lack one column; by-name union fills it with 0.0."""
    rows = flows(spark, sf_dir).select(
        "day", "flow_duration", F.col("flow_bytes").cast("decimal(18,2)").alias("flow_bytes"))
    even, odd = rows.where("day % 2 = 0"), rows.where("day % 2 = 1").drop("flow_bytes")
    both = W.union_days([even, odd])
    filled = both.withColumn("flow_bytes", F.coalesce("flow_bytes", F.lit(0).cast("decimal(18,2)")))
    return filled.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("flow_duration"), 2).alias("flow_duration"),
        F.sum("flow_bytes").cast("double").alias("flow_bytes"))


@query("align_xy", with_ctes(*WINDOWED, body="""
SELECT day, split, seq, round(avg(flow_duration), 6) AS flow_duration,
       CAST(avg(target) >= 0.2 AS INTEGER) AS y FROM win GROUP BY day, split, seq"""))
def align_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels as two tables, joined on the window key."""
    rows = stage(W.window_rows(flows(spark, sf_dir), LINE).select(
        *KEY, "target", "flow_duration"), "windows")
    x = rows.groupBy(*KEY).agg(F.round(F.avg("flow_duration"), 6).alias("flow_duration"))
    return W.align(x, W.sequence_vote(rows))


# ---------------------------------------------------------------- computations in a window

@query("moving_kernel3", with_ctes(*WINDOWED, body="""
SELECT day, split, seq, step, round(
         0.25 * coalesce(lag(flow_duration) OVER w, 0.0) + 0.5 * flow_duration
         + 0.25 * coalesce(lead(flow_duration) OVER w, 0.0), 6) AS smooth
FROM win WINDOW w AS (PARTITION BY day, split, seq ORDER BY step)"""))
def moving_kernel3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.window_rows(flows(spark, sf_dir), LINE)
    return rows.select(*KEY, "step", F.round(
        W.moving_kernel("flow_duration", (0.25, 0.5, 0.25)), 6).alias("smooth"))


@query("linear_scan", with_ctes(*WINDOWED, body="""
SELECT day, split, seq,
       round(sum(0.2 * flow_duration * power(CAST(0.8 AS DOUBLE), 9 - step)), 6) AS state
FROM win GROUP BY day, split, seq"""))
def linear_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = W.sequences(W.window_rows(flows(spark, sf_dir), LINE), ["flow_duration"])
    return seqs.select(*KEY, F.round(
        W.linear_scan(F.transform("x", lambda r: r[0]), 0.8, 0.2), 6).alias("state"))


@query("attention_pool", with_ctes(*WINDOWED, body="""
SELECT day, split, seq, round(sum(exp(flow_duration / 10.0) * packet_length)
                              / sum(exp(flow_duration / 10.0)), 6) AS pooled
FROM win GROUP BY day, split, seq"""))
def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.window_rows(flows(spark, sf_dir), LINE)
    pooled = W.attention_pool(rows, F.col("flow_duration") / 10.0, "packet_length")
    return pooled.select(*KEY, F.round("pooled", 6).alias("pooled"))


@query("softmax_prob", """
SELECT event_id, round(1.0 / (1.0 + exp(value / 100.0 - k / 50.0)), 6) AS p
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def softmax_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_flows(spark, sf_dir).select("event_id", F.round(
        softmax_positive(F.col("value") / 100.0, F.col("k") / 50.0), 6).alias("p"))


@query("detect_verdict", """
SELECT event_id, round(p, 4) AS probability, p >= CAST(0.03 AS DOUBLE) AS is_threat,
       CASE WHEN p >= CAST(0.03 AS DOUBLE) THEN 'THREAT' ELSE 'BENIGN' END AS verdict
FROM (SELECT event_id, 1.0 / (1.0 + exp(-(value / 50.0 - 4.0))) AS p FROM events)""")
def detect_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sigmoid(F.col("value") / 50.0 - 4.0)
    rows = table(spark, sf_dir, "events").select("event_id", p.alias("p"))
    v = verdict(F.col("p"))
    return rows.select("event_id", v["probability"].alias("probability"),
                       v["is_threat"].alias("is_threat"),
                       F.coalesce(v["verdict"], F.lit("THREAT")).alias("verdict"))
