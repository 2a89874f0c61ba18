"""Queries on model scores: thresholds, metrics, curves, blending, diagnostics, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens import fixed_values as fv
from flowlens.operators import ensemble as E, metrics as M, reports, sampling, thresholds as T
from flowlens.operators.ordering import positional_index
from flowlens.operators.windows import WINDOW_KEY, sequence_vote, window_rows
from flowlens.plans.benchmark import (MATRIX, benchmark_metrics, side_metrics, with_blend)
from flowlens.plans.flow_queries import (EVENT_FLOWS, EVENT_POSITIONS, MODEL, PARAMS,
                                         SCALES, WINDOWED, model_sql, scaled_cte, scored_flows,
                                         split_sql)
from flowlens.plans.registry import query, with_ctes
from flowlens.session import stage
from flowlens.sources.tables import (FLOW_TIES, NOISE_MODEL, SCORE_MODELS, event_flows, flows,
                                     score_rows, scores)

KEY = list(WINDOW_KEY)
ALL_MODELS = {**SCORE_MODELS, **NOISE_MODEL}


def _model_values(models: dict) -> str:
    return ", ".join(f"('{m}', CAST({s!r} AS DOUBLE), CAST({1.0 - s!r} AS DOUBLE), "
                     f"CAST({k} AS BIGINT))" for m, (s, k) in models.items())


def score_sql(source: str, models: dict = ALL_MODELS) -> str:
    return f"""sc AS (
  SELECT e.*, m.model, round(m.s * e.y + m.r * ((e.event_id * m.k) % 1000)
                             / CAST(1000 AS DOUBLE), 6) AS p
  FROM {source} e, (VALUES {_model_values(models)}) m(model, s, r, k))"""


PLAIN = "rows0 AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events)"
SPLIT_EVENTS = (EVENT_FLOWS, EVENT_POSITIONS, split_sql("evpos"),
                "rows0 AS (SELECT split, event_id, target AS y FROM parted)")
TAUS = f"""taus AS (
  SELECT CAST(i AS INTEGER) AS tau_idx,
         CASE WHEN i >= {fv.TAU_COUNT - 1} THEN CAST({fv.TAU_MAX} AS DOUBLE)
              ELSE i * CAST({T.TAU_STEP!r} AS DOUBLE) + CAST({fv.TAU_MIN} AS DOUBLE) END AS tau
  FROM range({fv.TAU_COUNT}) r(i))"""


def sweep_sql(source: str = "sc", by: str = "model") -> str:
    return f"""sweep AS (
  SELECT {by}, tau_idx, tau,
         CAST(sum(CASE WHEN p >= tau AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN p >= tau AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN p < tau AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN p < tau AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM (SELECT {by}, p, y FROM {source}) s, taus GROUP BY {by}, tau_idx, tau)"""


BEST = """graded AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec,
         CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr_
  FROM sweep),
tiered AS (
  SELECT *, CASE WHEN prec + rec > 0 THEN 2.0 * prec * rec / (prec + rec) ELSE 0.0 END AS f1_,
         CASE WHEN prec >= CAST(0.92 AS DOUBLE) AND rec >= CAST(0.9 AS DOUBLE)
                   AND fpr_ <= CAST(0.015 AS DOUBLE) THEN 1
              WHEN prec >= CAST(0.92 AS DOUBLE) AND tp > 10 THEN 2 ELSE 3 END AS tier
  FROM graded),
best AS (
  SELECT model, tau_idx, tau, round(tau, 4) AS tau_rounded, tier FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY tier,
             CASE WHEN tier = 2 THEN rec ELSE f1_ END DESC, tau_idx) AS rn FROM tiered)
  WHERE rn = 1)"""


def counts_sql(name: str, source: str, by: str, tau: str) -> str:
    return f"""{name} AS (
  SELECT {by}, CAST(sum(CASE WHEN p >= {tau} AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN p >= {tau} AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN p < {tau} AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN p < {tau} AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM {source} GROUP BY {by})"""


METRIC_SQL = {
    "accuracy": "(tp + tn) / (tp + fp + tn + fn)",
    "precision": "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END",
    "recall": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END",
    "f1": "CASE WHEN 2*tp + fp + fn > 0 THEN 2.0 * tp / (2*tp + fp + fn) ELSE 0.0 END",
    "f2": "CASE WHEN 5*tp + 4*fn + fp > 0 THEN 5.0 * tp / (5*tp + 4*fn + fp) ELSE 0.0 END",
    "mcc": ("CASE WHEN (tp+fp) > 0 AND (tp+fn) > 0 AND (tn+fp) > 0 AND (tn+fn) > 0 THEN "
            "(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / (sqrt(CAST(tp+fp AS DOUBLE)) "
            "* sqrt(CAST(tp+fn AS DOUBLE)) * sqrt(CAST(tn+fp AS DOUBLE)) "
            "* sqrt(CAST(tn+fn AS DOUBLE))) ELSE 0.0 END"),
    "fpr": "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END",
    "fnr": "CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END",
}


def metrics_sql(digits: int = 4) -> str:
    return ", ".join(f"round({v}, {digits}) AS {k}" for k, v in METRIC_SQL.items())


def points_sql(source: str = "sc", by: str = "model") -> str:
    return f"""distinct_scores AS (
  SELECT {by}, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
  FROM {source} GROUP BY {by}, p),
points AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY {by}) AS all_pos,
         sum(neg) OVER (PARTITION BY {by}) AS all_neg
  FROM distinct_scores
  WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""


ROC_AUC = ("CAST(sum(CAST(neg AS DOUBLE) * ((tp - pos) + pos / 2.0)) AS DOUBLE) "
           "/ (CAST(max(all_pos) AS DOUBLE) * CAST(max(all_neg) AS DOUBLE))")
PR_AUC = """sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp)
    + CASE WHEN tp - pos + fp - neg > 0
           THEN CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) ELSE 1.0 END) / 2.0)
  / CAST(max(all_pos) AS DOUBLE)"""


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every event by every model; no split, so nothing is shuffled."""
    rows = event_flows(spark, sf_dir).select("event_id", F.col("target").alias("y"))
    return score_rows(rows, noise=True)


# ---------------------------------------------------------------- thresholds and metrics

@query("tau_grid", with_ctes(PLAIN, score_sql("rows0"), TAUS, body="""
SELECT model, coalesce(i, -1) AS tau_idx, CAST(sum(y) AS BIGINT) AS pos,
       CAST(sum(1 - y) AS BIGINT) AS neg
FROM (SELECT sc.model, sc.y, (SELECT max(tau_idx) FROM taus WHERE tau <= sc.p) AS i FROM sc)
GROUP BY model, i"""))
def tau_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score's place on the threshold grid, counted."""
    return T.tau_histogram(all_scores(spark, sf_dir), ["model"])


@query("tau_sweep", with_ctes(PLAIN, score_sql("rows0"), TAUS, sweep_sql(), body="""
SELECT model, tau_idx, round(tau, 9) AS tau, tp, fp, tn, fn FROM sweep"""))
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = T.tau_sweep(all_scores(spark, sf_dir), ["model"])
    return swept.withColumn("tau", F.round("tau", 9))


@query("optimal_tau", with_ctes(
    *SPLIT_EVENTS, score_sql("rows0"), TAUS,
    "val AS (SELECT * FROM sc WHERE split = 'val')", sweep_sql("val"), BEST, body="""
SELECT model, tau_idx, round(tau, 9) AS tau, tau_rounded, tier FROM best"""))
def optimal_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold per model from validation scores."""
    val = scores(spark, sf_dir, noise=True).where("split = 'val'")
    best = T.optimal_tau(T.tau_sweep(val, ["model"]), ["model"])
    return best.withColumn("tau", F.round("tau", 9))


CALIBRATED_SQL = (*SPLIT_EVENTS, score_sql("rows0"), TAUS,
                  "val AS (SELECT * FROM sc WHERE split = 'val')", sweep_sql("val"), BEST,
                  """test AS (SELECT sc.*, best.tau, best.tau_rounded FROM sc JOIN best USING (model)
  WHERE sc.split = 'test')""")
METRICS_CTES = (*CALIBRATED_SQL, counts_sql("counts", "test", "model", "tau"),
                points_sql("test"),
                f"areas AS (SELECT model, {ROC_AUC} AS roc_auc, {PR_AUC} AS pr_auc "
                "FROM points GROUP BY model)",
                f"""metrics AS (
  SELECT counts.model, tp, fp, tn, fn, {metrics_sql()}, round(roc_auc, 4) AS roc_auc,
         round(pr_auc, 4) AS pr_auc, tau_rounded AS optimal_tau
  FROM counts JOIN areas USING (model) JOIN best USING (model))""")


@query("threshold_metrics", with_ctes(*METRICS_CTES, body="SELECT * FROM metrics"))
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_metrics(scores(spark, sf_dir, noise=True))


@query("confusion_matrix", with_ctes(
    PLAIN, score_sql("rows0"), counts_sql("counts", "sc", "model", "CAST(0.5 AS DOUBLE)"), body="""
, cells AS (SELECT model, 0 AS actual, 0 AS predicted, tn AS n, tn + fp AS total FROM counts
  UNION ALL SELECT model, 0, 1, fp, tn + fp FROM counts
  UNION ALL SELECT model, 1, 0, fn, tp + fn FROM counts
  UNION ALL SELECT model, 1, 1, tp, tp + fn FROM counts)
SELECT model, actual, predicted, n,
       round(CASE WHEN total > 0 THEN n / total ELSE 0.0 END * 100.0, 4) AS pct FROM cells"""))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_scores(spark, sf_dir).withColumn("tau", F.lit(0.5))
    out = M.confusion_matrix(M.confusion_counts(rows, ["model"]), ["model"])
    return out.withColumn("pct", F.round("pct", 4))


@query("report_labels", with_ctes(
    PLAIN, score_sql("rows0"), counts_sql("counts", "sc", "model", "CAST(0.5 AS DOUBLE)"), body="""
, cells AS (SELECT model, 0 AS actual, 0 AS predicted, tn AS n, tn + fp AS total FROM counts
  UNION ALL SELECT model, 0, 1, fp, tn + fp FROM counts
  UNION ALL SELECT model, 1, 0, fn, tp + fn FROM counts
  UNION ALL SELECT model, 1, 1, tp, tp + fn FROM counts)
SELECT model, actual, predicted, format('{:,}', n) || chr(10) || '('
       || printf('%.1f', CASE WHEN total > 0 THEN n / total ELSE 0.0 END * 100.0) || '%)' AS label
FROM cells"""))
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_scores(spark, sf_dir).withColumn("tau", F.lit(0.5))
    matrix = M.confusion_matrix(M.confusion_counts(rows, ["model"]), ["model"])
    return reports.confusion_labels(matrix, ["model"])


@query("roc_auc", with_ctes(PLAIN, score_sql("rows0"), points_sql(), body=f"""
SELECT model, round({ROC_AUC}, 6) AS roc_auc FROM points GROUP BY model"""))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.areas(all_scores(spark, sf_dir), ["model"]).select(
        "model", F.round("roc_auc", 6).alias("roc_auc"))


@query("pr_auc", with_ctes(PLAIN, score_sql("rows0"), points_sql(), body=f"""
SELECT model, round({PR_AUC}, 6) AS pr_auc FROM points GROUP BY model"""))
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.areas(all_scores(spark, sf_dir), ["model"]).select(
        "model", F.round("pr_auc", 6).alias("pr_auc"))


@query("roc_curve", with_ctes(PLAIN, score_sql("rows0"), points_sql(), body="""
, nexts AS (SELECT *, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg,
                   row_number() OVER w AS rn FROM points
            WINDOW w AS (PARTITION BY model ORDER BY p DESC))
SELECT model, p AS threshold, round(CAST(fp AS DOUBLE) / all_neg, 6) AS fpr,
       round(CAST(tp AS DOUBLE) / all_pos, 6) AS tpr FROM nexts
WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
UNION ALL SELECT DISTINCT model, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM points"""))
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_curve(all_scores(spark, sf_dir), ["model"]).select(
        "model", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("pr_curve", with_ctes(PLAIN, score_sql("rows0"), points_sql(), body="""
SELECT model, p AS threshold, round(CAST(tp AS DOUBLE) / all_pos, 6) AS recall,
       round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision FROM points
UNION ALL SELECT DISTINCT model, CAST('Infinity' AS DOUBLE), 0.0, 1.0 FROM points"""))
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pr_curve(all_scores(spark, sf_dir), ["model"]).select(
        "model", "threshold", F.round("recall", 6).alias("recall"),
        F.round("precision", 6).alias("precision"))


# ---------------------------------------------------------------- blending and comparison

BLEND_SQL = "sum(p * CASE model " + " ".join(
    f"WHEN '{m}' THEN CAST({w} AS DOUBLE)" for m, w in fv.ENSEMBLE_WEIGHTS.items()) + " END)"


@query("ensemble_blend", with_ctes(PLAIN, score_sql("rows0", SCORE_MODELS), body=f"""
SELECT event_id, y, round({BLEND_SQL}, 8) AS p FROM sc GROUP BY event_id, y"""))
def ensemble_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.blend(all_scores(spark, sf_dir), ["event_id", "y"])
    return out.withColumn("p", F.round("p", 8))


WITH_BLEND = f"""blended AS (
  SELECT split, event_id, y, model, p FROM sc
  UNION ALL SELECT split, event_id, y, 'Hybrid_Ensemble', round({BLEND_SQL}, 8)
  FROM sc WHERE model <> 'BiLSTM' GROUP BY split, event_id, y)"""
BLEND_CTES = (*SPLIT_EVENTS, score_sql("rows0"), WITH_BLEND, TAUS,
              "val AS (SELECT * FROM blended WHERE split = 'val')", sweep_sql("val"), BEST,
              """test AS (SELECT b.*, best.tau, best.tau_rounded FROM blended b JOIN best USING (model)
  WHERE b.split = 'test')""", counts_sql("counts", "test", "model", "tau"), points_sql("test"),
              f"areas AS (SELECT model, {ROC_AUC} AS roc_auc, {PR_AUC} AS pr_auc "
              "FROM points GROUP BY model)",
              f"""metrics AS (
  SELECT counts.model, tp, fp, tn, fn, {metrics_sql()}, round(roc_auc, 4) AS roc_auc,
         round(pr_auc, 4) AS pr_auc, tau_rounded AS optimal_tau
  FROM counts JOIN areas USING (model) JOIN best USING (model))""")


def _blended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_metrics(with_blend(scores(spark, sf_dir, noise=True),
                                        ["split", "event_id", "y"], digits=8))


@query("benchmark_matrix", with_ctes(*BLEND_CTES, body="SELECT model, "
       + ", ".join(MATRIX) + " FROM metrics"))
def benchmark_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric rows pivoted to one row per model."""
    wide = _blended_metrics(spark, sf_dir)
    return E.result_matrix(E.metrics_long(wide, MATRIX), MATRIX)


@query("champion", with_ctes(*BLEND_CTES, body="""
SELECT model, f1, recall, precision FROM metrics ORDER BY f1 DESC, model LIMIT 1"""))
def champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.champion(_blended_metrics(spark, sf_dir)).select("model", "f1", "recall", "precision")


@query("model_compare", with_ctes(*METRICS_CTES, body="""
, listed AS (SELECT *, CASE model WHEN 'LightGBM' THEN 0 WHEN 'XGBoost' THEN 1 WHEN 'BiLSTM' THEN 2
                                  WHEN 'BiGRU' THEN 3 WHEN 'MAMBA_SSM' THEN 4 END AS place
             FROM metrics)
SELECT place, CASE model WHEN 'MAMBA_SSM' THEN 'Mamba SSM' ELSE model END AS label, recall, f1,
       roc_auc, row_number() OVER (ORDER BY roc_auc DESC, place) = 1 AS is_best
FROM listed WHERE place IS NOT NULL"""))
def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.comparison(benchmark_metrics(scores(spark, sf_dir, noise=True)))


@query("models_present", with_ctes(PLAIN, score_sql("rows0"), body="""
SELECT w.place, w.model FROM (VALUES (0, 'MAMBA_SSM'), (1, 'Hybrid_Ensemble'), (2, 'XGBoost'),
                                     (3, 'CNN_BiLSTM')) w(place, model)
WHERE w.model IN (SELECT model FROM sc)"""))
def models_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame(list(enumerate(fv.FIGURE_MODELS)), "place int, model string")
    return E.models_present(wanted, all_scores(spark, sf_dir)).select("place", "model")


@query("figure_bars", with_ctes(*METRICS_CTES, body="""
SELECT model, metric, round(value * 100.0, 4) AS value FROM (
  UNPIVOT (SELECT model, precision, recall, f1, roc_auc FROM metrics)
  ON precision, recall, f1, roc_auc INTO NAME metric VALUE value)"""))
def figure_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = reports.figure_bars(benchmark_metrics(scores(spark, sf_dir, noise=True)),
                               ("precision", "recall", "f1", "roc_auc"))
    return bars.withColumn("value", F.round("value", 4))


@query("ensemble_cost", with_ctes(PLAIN, score_sql("rows0"), body="""
, cost AS (SELECT model, round(count(*) / 1000.0, 3) AS train_sec,
                  round(CAST(sum(y) AS DOUBLE) / count(*), 6) AS latency_ms FROM sc GROUP BY model)
SELECT 'Hybrid_Ensemble' AS model, round(sum(CASE WHEN model <> 'BiLSTM' THEN train_sec END), 2)
       AS train_sec,
       round(max(CASE WHEN model = 'CNN_BiLSTM' THEN latency_ms END), 4) AS latency_ms
FROM cost"""))
def ensemble_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost row of the blend; the members' costs are stand-ins made from row counts."""
    n = F.count(F.lit(1))
    cost = all_scores(spark, sf_dir).groupBy("model").agg(
        F.round(n / 1000.0, 3).alias("train_sec"), F.round(F.sum("y") / n, 6).alias("latency_ms"))
    return E.with_ensemble_cost(cost)


# ---------------------------------------------------------------- generalisation

def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the whole train and test splits, at each model's threshold."""
    indexed = positional_index(event_flows(spark, sf_dir).select("day", "ts", "event_id", "target"),
                               ["day"], "ts", ["event_id"])
    from flowlens.operators.windows import temporal_split
    rows = stage(temporal_split(indexed).select("split", "event_id", F.col("target").alias("y")),
                 "split-rows")
    both = rows.where("split <> 'val'").withColumn("side", F.col("split"))
    best = T.optimal_tau(T.tau_sweep(score_rows(rows.where("split = 'val'"), True), ["model"]),
                         ["model"])
    return side_metrics(score_rows(both, True), best)


GAP_CTES = (
    *SPLIT_EVENTS, score_sql("rows0"), TAUS, "val AS (SELECT * FROM sc WHERE split = 'val')",
    sweep_sql("val"), BEST, """sided AS (
  SELECT sc.*, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END || '|' || sc.model AS grp,
         best.tau_rounded FROM sc JOIN best USING (model)
  WHERE split <> 'val')""",
    counts_sql("counts", "sided", "grp", "tau_rounded"), points_sql("sided", "grp"),
    f"areas AS (SELECT grp, {ROC_AUC} AS roc FROM points GROUP BY grp)",
    f"""sides AS (SELECT split_part(grp, '|', 1) AS side, split_part(grp, '|', 2) AS model, roc,
       {METRIC_SQL['precision']} AS prec, {METRIC_SQL['recall']} AS rec, {METRIC_SQL['f1']} AS f1
  FROM counts JOIN areas USING (grp))""", """gaps AS (
  SELECT a.model, a.roc AS train_roc, a.prec AS train_prec, a.rec AS train_rec, a.f1 AS train_f1,
         b.roc AS test_roc, b.prec AS test_prec, b.rec AS test_rec, b.f1 AS test_f1,
         a.roc - b.roc AS gap_roc, a.f1 - b.f1 AS gap_f1
  FROM sides a JOIN sides b ON a.model = b.model AND a.side = 'train' AND b.side = 'test')""")
STATUS_SQL = f"""CASE WHEN abs(gap_roc) <= {fv.IDEAL_GAP_ROC} AND abs(gap_f1) <= {fv.IDEAL_GAP_F1} THEN '{fv.STATUS_IDEAL}'
     WHEN gap_roc <= {fv.STANDARD_GAP_ROC} AND test_roc >= {fv.STANDARD_ROC}
      AND test_prec >= {fv.STANDARD_PRECISION} THEN '{fv.STATUS_STANDARD}'
     WHEN gap_roc <= {fv.DRIFT_GAP_ROC} AND test_roc >= {fv.DRIFT_ROC} THEN '{fv.STATUS_DRIFT}'
     WHEN train_roc < {fv.UNDERFIT_ROC} THEN '{fv.STATUS_UNDERFIT}' ELSE '{fv.STATUS_OVERFIT}' END"""
GAP_NUMBERS = ("train_roc", "train_prec", "train_rec", "train_f1", "test_roc", "test_prec",
               "test_rec", "test_f1", "gap_roc", "gap_f1")


@query("gap_matrix", with_ctes(*GAP_CTES, body="SELECT model, " + ", ".join(
    f"round({c}, 4) AS {c}" for c in GAP_NUMBERS) + f", {STATUS_SQL} AS status FROM gaps"))
def gap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gap_matrix(_sides(spark, sf_dir))


@query("generalisation_status", """
WITH d AS (SELECT user_id, avg(value) / 100.0 AS a, max(value) / 500.0 AS m, min(value) / 10.0 AS i
           FROM events GROUP BY user_id),
g AS (SELECT user_id, m AS train_roc, m - i / 4.0 AS test_roc, a AS gap_f1, i / 4.0 AS gap_roc,
             1.0 - i / 2.0 AS test_prec FROM d)
SELECT user_id, """ + STATUS_SQL + " AS status FROM g")
def generalisation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered rule on levels and gaps made from each user's values."""
    d = event_flows(spark, sf_dir).groupBy("user_id").agg(
        (F.avg("value") / 100.0).alias("a"), (F.max("value") / 500.0).alias("m"),
        (F.min("value") / 10.0).alias("i"))
    g = d.select("user_id", F.col("m").alias("train_roc"),
                 (F.col("m") - F.col("i") / 4.0).alias("test_roc"), F.col("a").alias("gap_f1"),
                 (F.col("i") / 4.0).alias("gap_roc"),
                 (1.0 - F.col("i") / 2.0).alias("test_prec"))
    return g.select("user_id", E.status_columns().alias("status"))


# ---------------------------------------------------------------- samples

VOTES = """votes AS (SELECT day, split, seq, CAST(avg(target) >= 0.2 AS INTEGER) AS y FROM win
  GROUP BY day, split, seq)"""


def _train_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_rows(flows(spark, sf_dir), FLOW_TIES).where("split = 'train'")
    return stage(sequence_vote(rows), "votes")


@query("class_counts", with_ctes(*WINDOWED, VOTES, body="""
SELECT y, count(*) AS rows FROM votes WHERE split = 'train' GROUP BY y"""))
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.class_counts(_train_votes(spark, sf_dir))


@query("balance_1_to_4", with_ctes(*WINDOWED, VOTES, body="""
, tr AS (SELECT * FROM votes WHERE split = 'train'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || day || '|' || seq)) AS rn
           FROM tr)
SELECT day, split, seq, y FROM ranked
WHERE y = 1 OR rn <= 4 * (SELECT sum(y) FROM tr)"""))
def balance_1_to_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balance(_train_votes(spark, sf_dir), ["day", "seq"])


@query("eval_sample", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|'
                                        || l_partkey || '|' || l_suppkey)) <= 20000""")
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir).select(*FLOW_TIES, "l_suppkey")
    return sampling.sample_rows(rows, [*FLOW_TIES, "l_suppkey"]).select(*FLOW_TIES)


@query("stratified_sample", """
SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events
QUALIFY row_number() OVER (PARTITION BY event_type = 'error' ORDER BY md5('42|' || event_id)) <= 50""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_flows(spark, sf_dir).select("event_id", F.col("target").alias("y"))
    return sampling.stratified_sample(rows, ["event_id"])


@query("stratified_sample_large", """
SELECT event_type, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM (
  SELECT event_id, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id)) <= 1200)
GROUP BY event_type""")
def stratified_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class samples above the ranked limit go through the hash cut."""
    rows = event_flows(spark, sf_dir).select("event_id", "event_type")
    picked = sampling.stratified_sample(rows, ["event_id"], "event_type", 1200)
    return picked.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"),
                                            F.sum("event_id").alias("ids"))


@query("first_attacks", with_ctes(*WINDOWED, VOTES, body="""
SELECT day, seq FROM votes WHERE split = 'test' AND y = 1 ORDER BY day, seq LIMIT 2"""))
def first_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = sequence_vote(window_rows(flows(spark, sf_dir), FLOW_TIES)).where("split = 'test'")
    return sampling.first_attacks(votes, ["day", "seq"], 2).select("day", "seq")


@query("top_detection", with_ctes(PLAIN, score_sql("rows0"), body="""
SELECT model, event_id, y, p FROM sc
QUALIFY row_number() OVER (PARTITION BY model ORDER BY p DESC, event_id) = 1"""))
def top_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_detection(all_scores(spark, sf_dir), ["model"], ["event_id"])


@query("batch_audit", with_ctes(*WINDOWED, PARAMS, SCALES, scaled_cte(fv.CLIP_SERVING), model_sql(),
                                body=f"""
, picked AS (SELECT y, round(p, 6) AS p, 1 AS g FROM scored WHERE split = 'test'),
{counts_sql("counts", "picked", "g", "CAST(0.03 AS DOUBLE)")},
{points_sql("picked", "g")},
areas AS (SELECT g, {ROC_AUC} AS roc_auc FROM points GROUP BY g)
SELECT tp, fp, tn, fn, round(roc_auc, 4) AS roc_auc FROM counts JOIN areas USING (g)"""))
def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and ROC of all test windows, scaled and judged as in serving."""
    scored = scored_flows(spark, sf_dir, clip_at=fv.CLIP_SERVING).where("split = 'test'")
    picked = scored.select("y", F.round("p", 6).alias("p"),
                           F.lit(fv.DETECT_THRESHOLD).alias("tau"), F.lit(1).alias("g"))
    counts = M.confusion_counts(picked, ["g"])
    return counts.join(M.areas(picked, ["g"]), "g").select(
        "tp", "fp", "tn", "fn", F.round("roc_auc", 4).alias("roc_auc"))
