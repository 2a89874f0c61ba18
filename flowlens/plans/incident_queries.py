"""Queries on incidents: lookup, projection, actions, roll-up and the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.text import render_rules, rules_excerpt
from flowlens.operators import incidents as I, metrics as M, reports
from flowlens.plans.flow_queries import scored_flows
from flowlens.plans.registry import query, with_ctes
from flowlens.plans.score_queries import (PLAIN, ROC_AUC, all_scores, counts_sql, points_sql,
                                          score_sql)
from flowlens.plans.text_queries import SALIENT, catalogue_values, saliency_sql
from flowlens.sources import requests as req
from flowlens.sources.catalogue import display_names, threat_catalogue
from flowlens.sources.tables import actions_fixture, incidents_fixture, table

IDS_SQL = "[" + ", ".join(f"'{t[0]}'" for t in fv.THREATS) + ", 'MITRE-T0000']"
INCIDENTS = f"""inc AS (
  SELECT event_id, ts, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
         ({IDS_SQL})[event_id % 7 + 1] AS threat_id,
         round((event_id * 7919) % 1000 / 1000.0, 4) AS probability
  FROM events WHERE event_type = 'error')"""
ACTIONS = """act AS (
  SELECT event_id AS action_id, ts, '10.0.' || ((2 * user_id) // 256) || '.' || ((2 * user_id) % 256) AS src_ip,
         (['block', 'report', 'ignore'])[event_id % 3 + 1] AS action
  FROM events WHERE event_type = 'signup')"""
KB = catalogue_values()
NAMES_SQL = "nm AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in fv.DISPLAY_NAMES.items()) + ") n(threat_id, display))"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_fixture(spark, sf_dir).withColumn("p", F.col("probability"))


@query("threat_lookup", with_ctes(KB, INCIDENTS, body="""
SELECT event_id, src_ip, threat_id, title, tactic, playbook, array_to_string(iptables, chr(10)) AS rules
FROM inc LEFT JOIN kb USING (threat_id)"""))
def threat_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_threat(incidents_fixture(spark, sf_dir), threat_catalogue(spark)).select(
        "event_id", "src_ip", "threat_id", "title", "tactic", "playbook",
        F.array_join("iptables", "\n").alias("rules"))


@query("display_name_fallback", with_ctes(KB, NAMES_SQL, INCIDENTS, body="""
SELECT event_id, threat_id, coalesce(display, title) AS threat_name
FROM inc LEFT JOIN kb USING (threat_id)
     LEFT JOIN (SELECT * FROM nm WHERE threat_id <> 'MITRE-T1071') USING (threat_id)"""))
def display_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One display name is left out, so the catalogue title stands in for it."""
    names = display_names(spark).where("threat_id <> 'MITRE-T1071'")
    rows = I.with_threat(incidents_fixture(spark, sf_dir), threat_catalogue(spark))
    return I.with_display_name(rows, names).select("event_id", "threat_id", "threat_name")


@query("incident_projection", with_ctes(KB, NAMES_SQL, INCIDENTS, body=f"""
SELECT event_id, coalesce(display, title) AS threat_name, threat_id, tactic,
       round(probability * 100.0, 1) AS confidence, round(probability, 4) AS probability, src_ip,
       '{fv.STATUS_DETECTED}' AS status, playbook, indicators,
       replace(array_to_string(iptables, chr(10)), '{{src_ip}}', src_ip) AS rules
FROM inc LEFT JOIN kb USING (threat_id) LEFT JOIN nm USING (threat_id)"""))
def incident_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = I.incidents(_detections(spark, sf_dir), threat_catalogue(spark), display_names(spark))
    return full.select("event_id", "threat_name", "threat_id", "tactic", "confidence", "probability",
                       "src_ip", "status", "playbook", "indicators",
                       F.array_join("rules", "\n").alias("rules"))


@query("render_rules", with_ctes(KB, INCIDENTS, body="""
SELECT event_id, replace(array_to_string(iptables, ' ; '), '{src_ip}', src_ip) AS rules,
       left(replace(array_to_string(iptables[1:3], chr(10)), '{src_ip}', '0.0.0.0'), 120) AS excerpt
FROM inc LEFT JOIN kb USING (threat_id)"""))
def render_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_threat(incidents_fixture(spark, sf_dir), threat_catalogue(spark))
    return rows.select(
        "event_id", F.array_join(render_rules(F.col("iptables"), F.col("src_ip")), " ; ").alias("rules"),
        rules_excerpt(F.col("iptables"), F.lit("0.0.0.0")).alias("excerpt"))


@query("incident_ids", with_ctes(INCIDENTS, body="""
SELECT event_id, printf('INC-2026-NIDS-%05d', row_number() OVER (ORDER BY ts, event_id)) AS incident_id
FROM inc"""))
def incident_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents_fixture(spark, sf_dir).select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return I.incident_numbers(rows, "day", "ts", ["event_id"]).select("event_id", "incident_id")


@query("parse_props_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       'unknown' AS src_ip, 0 AS dst_port FROM events""")
def parse_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed JSON with absent fields filled by defaults."""
    r = F.from_json("props", "k int, src_ip string, dst_port int")
    rows = table(spark, sf_dir, "events").select("event_id", r.alias("r"))
    return rows.select("event_id", "r.k",
                       F.coalesce("r.src_ip", F.lit(fv.DEFAULT_SRC_IP)).alias("src_ip"),
                       F.coalesce("r.dst_port", F.lit(fv.DEFAULT_DST_PORT)).alias("dst_port"))


@query("request_quarantine", """
SELECT event_id % 5 AS kind, CASE event_id % 5 WHEN 1 THEN 'wrong number of steps'
         WHEN 2 THEN 'features are not a numeric matrix'
         WHEN 3 THEN 'wrong number of features or a value that is not a number'
         ELSE 'scored' END AS outcome, count(*) AS rows,
       round(sum(CASE WHEN event_id % 5 IN (0, 4) THEN 10 * value ELSE 0.0 END), 2) AS total
FROM events GROUP BY ALL""")
def request_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from events, one in five of each kind of damage; only sound ones are scored."""
    v = F.col("value").cast("string")
    step = F.concat(F.lit("["), v, F.lit(",1.0]"))

    def matrix(n: int):
        return F.concat(F.lit("["), F.array_join(F.array_repeat(step, n), ","), F.lit("]"))

    kind = F.col("event_id") % 5
    features = (F.when(kind == 1, matrix(9)).when(kind == 2, F.lit('"none"'))
                .when(kind == 3, F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("[1.0]"), 10), ","),
                                          F.lit("]"))).otherwise(matrix(10)))
    body = F.concat(F.lit('{"features":'), features, F.lit(',"src_ip":"10.0.0.1"}'))
    raw = table(spark, sf_dir, "events").select("event_id", body.alias("value"))
    good, bad = req.split_requests(req.parse_requests(raw), 10, 2)
    total = F.aggregate("features", F.lit(0.0), lambda a, r: a + r[0])
    both = good.select("event_id", F.lit("scored").alias("outcome"), total.alias("t")).unionByName(
        bad.select("event_id", F.col("error").alias("outcome"), F.lit(0.0).alias("t")))
    return both.groupBy((F.col("event_id") % 5).alias("kind"), "outcome").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("t"), 2).alias("total"))


# ---------------------------------------------------------------- registry and actions

REGISTRY_SQL = """reg AS (SELECT src_ip, threat_id, event_id FROM inc
  QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, event_id DESC) = 1)"""


@query("incident_registry", with_ctes(INCIDENTS, REGISTRY_SQL, body="SELECT * FROM reg"))
def incident_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.registry(incidents_fixture(spark, sf_dir), ["ts", "event_id"]).select(
        "src_ip", "threat_id", "event_id")


@query("action_join", with_ctes(INCIDENTS, REGISTRY_SQL, ACTIONS, body=f"""
SELECT action_id, act.src_ip, action, reg.src_ip IS NOT NULL AS found,
       CASE WHEN reg.src_ip IS NULL THEN 'not found' WHEN action = 'block' THEN '{fv.STATUS_BLOCKED}'
            ELSE '{fv.STATUS_DETECTED}' END AS status,
       CASE WHEN action = 'block' THEN 'iptables -A INPUT -s ' || act.src_ip || ' -j DROP'
            ELSE '' END AS rule
FROM act LEFT JOIN reg USING (src_ip)"""))
def action_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = I.registry(incidents_fixture(spark, sf_dir), ["ts", "event_id"])
    done = I.apply_actions(actions_fixture(spark, sf_dir), active)
    return done.select("action_id", "src_ip", "action", "found",
                       F.coalesce("status", F.lit("not found")).alias("status"),
                       F.coalesce("rule", F.lit("")).alias("rule"))


# ---------------------------------------------------------------- roll-up and catalogue

ROLLUP = """rollup_ AS (SELECT threat_id, count(*) AS occurrences,
         min_by(probability, ts) AS hybrid_score FROM inc LEFT JOIN kb USING (threat_id)
  GROUP BY threat_id)"""


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = I.with_threat(incidents_fixture(spark, sf_dir), threat_catalogue(spark))
    return I.threat_rollup(known.withColumnRenamed("probability", "hybrid_score"),
                           ["ts", "event_id"], "hybrid_score")


@query("threat_rollup", with_ctes(KB, INCIDENTS, ROLLUP, body="""
SELECT threat_id, title, tactic, occurrences, hybrid_score FROM rollup_ LEFT JOIN kb USING (threat_id)"""))
def threat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = threat_catalogue(spark).select("threat_id", "title", "tactic")
    return _rollup(spark, sf_dir).join(F.broadcast(catalogue), "threat_id", "left").select(
        "threat_id", "title", "tactic", "occurrences", "hybrid_score")


FEW = "few AS (SELECT * FROM inc WHERE threat_id IN ('MITRE-T1498', 'MITRE-T1071', 'MITRE-T0000'))"


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_fixture(spark, sf_dir).where(
        F.col("threat_id").isin("MITRE-T1498", "MITRE-T1071", "MITRE-T0000"))


@query("catalogue_flag", with_ctes(KB, INCIDENTS, FEW, body="""
SELECT threat_id, title, CASE WHEN threat_id IN (SELECT threat_id FROM few) THEN 'DETECTED'
       ELSE '—' END AS flag FROM kb"""))
def catalogue_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.catalogue_flags(threat_catalogue(spark), _few(spark, sf_dir))


@query("catalogue_undetected", with_ctes(KB, INCIDENTS, FEW, body="""
SELECT threat_id, title FROM kb WHERE threat_id NOT IN (SELECT threat_id FROM few)"""))
def catalogue_undetected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.undetected(threat_catalogue(spark), _few(spark, sf_dir))


@query("threat_cards", with_ctes(KB, INCIDENTS, ROLLUP, body="""
SELECT threat_id, title, tactic, occurrences, round(hybrid_score, 4) AS score,
       left(indicators, 80) || '...' AS indicators FROM rollup_ LEFT JOIN kb USING (threat_id)"""))
def threat_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threat_cards(_rollup(spark, sf_dir), threat_catalogue(spark), "hybrid_score")


@query("playbook_table", with_ctes(KB, INCIDENTS, ROLLUP, body="""
SELECT threat_id, title, left(playbook, 90) || '...' AS playbook,
       left(replace(array_to_string(iptables[1:3], chr(10)), '{src_ip}', '0.0.0.0'), 120) AS rules,
       occurrences FROM rollup_ LEFT JOIN kb USING (threat_id)"""))
def playbook_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.playbook_table(_rollup(spark, sf_dir), threat_catalogue(spark))


@query("incident_sheet", with_ctes(KB, NAMES_SQL, INCIDENTS, body=f"""
, f AS (SELECT event_id, coalesce(display, title) AS threat_name, threat_id, tactic,
       round(probability * 100.0, 1) AS confidence, src_ip, playbook, indicators
  FROM inc LEFT JOIN kb USING (threat_id) LEFT JOIN nm USING (threat_id))
SELECT event_id, 0 AS place, 'Threat' AS field, threat_name AS value FROM f
UNION ALL SELECT event_id, 1, 'MITRE ATT&CK', threat_id FROM f
UNION ALL SELECT event_id, 2, 'Tactic', tactic FROM f
UNION ALL SELECT event_id, 3, 'Confidence', printf('%.1f', confidence) || '%' FROM f
UNION ALL SELECT event_id, 4, 'Source IP', src_ip FROM f
UNION ALL SELECT event_id, 5, 'Status', '{fv.STATUS_DETECTED}' FROM f
UNION ALL SELECT event_id, 6, 'Playbook', playbook FROM f
UNION ALL SELECT event_id, 7, 'Indicators', left(indicators, 300) FROM f"""))
def incident_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = I.incidents(_detections(spark, sf_dir), threat_catalogue(spark), display_names(spark))
    return reports.incident_sheet(full, ["event_id"])


# ---------------------------------------------------------------- summaries

@query("kpi_summary", with_ctes(
    KB, INCIDENTS, PLAIN, score_sql("rows0"),
    "one AS (SELECT * FROM sc WHERE model = 'XGBoost')",
    counts_sql("counts", "one", "model", "CAST(0.5 AS DOUBLE)"), points_sql("one"),
    f"areas AS (SELECT model, {ROC_AUC} AS roc_auc FROM points GROUP BY model)", body="""
SELECT tp + fp AS threats_detected, tp + fp + tn + fn AS samples, round(roc_auc, 4) AS roc_auc,
       (SELECT count(DISTINCT threat_id) FROM inc) AS threat_types,
       (SELECT count(*) FROM kb) AS catalogue_size,
       printf('%.1f', CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END * 100.0) || '%' AS fnr,
       fn AS missed
FROM counts JOIN areas USING (model)"""))
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = all_scores(spark, sf_dir).where("model = 'XGBoost'").withColumn("tau", F.lit(0.5))
    counts = M.confusion_counts(one, ["model"]).join(M.areas(one, ["model"]), "model")
    return reports.kpi_summary(counts, incidents_fixture(spark, sf_dir), threat_catalogue(spark))


@query("health_summary", with_ctes(KB, INCIDENTS, body="""
SELECT 'healthy' AS status, (SELECT count(*) FROM kb) AS threats_in_kb,
       count(DISTINCT threat_id) AS threats_detected, 10 AS input_length, 4 AS input_width FROM inc"""))
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health_summary(incidents_fixture(spark, sf_dir), threat_catalogue(spark), 10, 4)


@query("metrics_summary", with_ctes(
    INCIDENTS, PLAIN, score_sql("rows0"), counts_sql("counts", "sc", "model", "CAST(0.03 AS DOUBLE)"),
    points_sql(), f"areas AS (SELECT model, {ROC_AUC} AS roc_auc FROM points GROUP BY model)", body="""
SELECT model, tp, fp, tn, fn, round(roc_auc, 4) AS roc_auc,
       (SELECT count(DISTINCT threat_id) FROM inc) AS threat_types_detected
FROM counts JOIN areas USING (model)"""))
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ROC of every model at the serving threshold, with the threat types seen."""
    rows = all_scores(spark, sf_dir).withColumn("tau", F.lit(fv.DETECT_THRESHOLD))
    types = incidents_fixture(spark, sf_dir).agg(F.countDistinct("threat_id")).scalar()
    return M.confusion_counts(rows, ["model"]).join(M.areas(rows, ["model"]), "model").select(
        "model", "tp", "fp", "tn", "fn", F.round("roc_auc", 4).alias("roc_auc"),
        types.alias("threat_types_detected"))


@query("root_cause", with_ctes(*SALIENT, saliency_sql(4), body="""
, m AS (SELECT name, avg(importance) AS importance FROM sal
        WHERE round(p, 6) >= 0.5 GROUP BY name)
SELECT left(name, 20) AS name,
       printf('%.4f', importance / (SELECT sum(importance) FROM m)) AS value FROM m"""))
def root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean saliency of detected windows per feature, as the report's bar labels."""
    hits = scored_flows(spark, sf_dir).where(F.round("p", 6) >= 0.5)
    mean = hits.select(F.explode("saliency").alias("s")).groupBy("s.name").agg(
        F.avg("s.importance").alias("importance"))
    cells = F.sort_array(F.collect_list(F.struct("importance", "name")), asc=False)
    listed = mean.agg(cells.alias("c")).select(F.explode("c").alias("c"), F.aggregate(
        "c", F.lit(0.0), lambda a, s: a + s["importance"]).alias("t"))
    return reports.importance_labels(
        listed.select(F.col("c.name").alias("name"),
                      (F.col("c.importance") / F.col("t")).alias("importance")), [])


@query("detect_response", with_ctes(KB, INCIDENTS, body="""
SELECT event_id, CASE WHEN probability >= 0.5
  THEN concat_ws('|', 'MITRE', threat_id, title) ELSE 'BENIGN' END AS outcome,
  round(probability, 4) AS probability
FROM inc LEFT JOIN kb USING (threat_id)"""))
def detect_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON responses, read back to show what each branch carries."""
    rows = I.with_threat(_detections(spark, sf_dir), threat_catalogue(spark))
    v = I.verdict(F.col("p"), 0.5)
    rows = rows.withColumns({
        "is_threat": v["is_threat"], "incident_id": F.lit("INC"),
        "hybrid_score": F.col("p"), "rules": render_rules(F.col("iptables"), F.col("src_ip")),
        "top_features": F.array(F.struct(F.lit("flow_bytes").alias("name"),
                                         F.lit(1.0).alias("importance")))})
    body = rows.select("event_id", req.detection_response().alias("j"))
    read = F.from_json("j", "detection struct<is_threat:boolean,probability:double>, "
                            "threat struct<id:string,title:string>, verdict string")
    r = body.select("event_id", read.alias("r"))
    return r.select("event_id", F.coalesce(
        "r.verdict", F.concat_ws("|", F.lit("MITRE"), F.col("r.threat.id"), F.col("r.threat.title")))
        .alias("outcome"), F.col("r.detection.probability").alias("probability"))
