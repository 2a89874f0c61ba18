"""Boundary cases and exactness of the bucketed operators against brute force."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.numeric import to_number
from flowlens.functions.timeparse import parse_time, pick_format
from flowlens.functions.vectors import first_max, l2_normalise, min_max
from flowlens.operators import blocks, explain, metrics as M, models, ordering, retrieval as R, windows as W
from flowlens.operators.quality import audit_days, find_label_column, find_timestamp_column
from flowlens.operators.selection import allowed_columns, kept_features

T0 = dt.datetime(1969, 12, 31, 23, 59)


@pytest.mark.parametrize("n,train,val", [(90, 62, 14), (170, 118, 26), (100, 70, 15), (7, 4, 1), (1, 0, 0)])
def test_split_cuts_are_truncated_double_products(spark, n, train, val):
    rows = spark.range(n).select(F.lit(1).alias("day"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("n"))
    got = {r.split: r["count"] for r in W.temporal_split(rows).groupBy("split").count().collect()}
    assert (got.get("train", 0), got.get("val", 0)) == (train, val)
    assert (train, train + val) == (int(n * 0.70), int(n * 0.85))


def crowded_rows(kind):
    """Days with a third of the rows in one time stamp, one minute, or 10 ms; ties skewed or not."""
    rng = random.Random(4)
    spans = {"stamp": lambda: dt.timedelta(seconds=30), "minute": lambda: dt.timedelta(microseconds=rng.randint(0, 59_999_999)),
             "burst": lambda: dt.timedelta(seconds=7, microseconds=rng.randint(0, 9_999))}
    rest = lambda: dt.timedelta(seconds=rng.randint(0, 90000))
    ids = list(range(2400))
    rng.shuffle(ids)
    rows = []
    for i in range(2400):
        span = spans[kind] if i % 3 == 0 else spans["minute"] if i % 3 == 1 else rest
        # the first tie-break is one value for most rows, and far from evenly spread for the others
        rows.append((i % 2, T0 + span(), 7 if rng.random() < 0.8 else int(10 ** rng.uniform(0, 9)), float(ids[i]) ** 3, ids[i]))
    return rows


@pytest.mark.parametrize("kind", ["stamp", "minute", "burst"])
@pytest.mark.parametrize("most", [10 ** 6, 60])
def test_position_with_crowded_times(spark, monkeypatch, kind, most):
    df = spark.createDataFrame(crowded_rows(kind), "day int, ts timestamp, tie long, skew double, id long")
    monkeypatch.setattr(ordering, "BUCKET_ROWS", most)
    ties = ["tie", "skew", "id"]
    got = ordering.positional_index(df, ["day"], "ts", ties)
    w = Window.partitionBy("day").orderBy("ts", *ties)
    want = df.withColumn("pos", F.row_number().over(w).cast("long") - 1)
    assert got.select("day", "id", "pos").exceptAll(want.select("day", "id", "pos")).count() == 0
    assert {r.n for r in got.select("n").distinct().collect()} == {1200}


@pytest.mark.parametrize("kind", ["stamp", "minute", "burst"])
@pytest.mark.parametrize("few", [True, False])
def test_no_bucket_is_larger_than_the_bound(spark, monkeypatch, kind, few):
    if not few:
        monkeypatch.setattr(ordering, "MOST_LITERAL", 0)
    df = spark.createDataFrame(crowded_rows(kind), "day int, ts timestamp, tie long, skew double, id long")
    out = ordering.order_buckets(df, "ts", ["tie", "skew", "id"], most=60)
    assert out.groupBy(*ordering.ORDER_BUCKETS).count().agg(F.max("count")).first()[0] <= 60
    rows = sorted(out.collect(), key=lambda r: (r.ts, r.tie, r.skew, r.id))
    paths = [(r._slot, r._path) for r in rows]
    assert paths == sorted(paths) and len(rows) == 2400


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [0.0] * 50 + [1e-300, -1e-300, 1e300, -1e300],
    list(np.random.RandomState(1).standard_cauchy(999)), [3.25] * 700 + list(range(300)),
    list(1e6 + np.random.RandomState(2).rand(500) * 1e-3)])
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    probs = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r.prob: r.q for r in ordering.exact_quantiles(df, "k", "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(np.array(values, float), p), rel=1e-12, abs=1e-300)


def test_score_bucket_is_monotone(spark):
    rng = np.random.RandomState(7)
    p = np.unique(np.concatenate([rng.rand(3000), 10.0 ** -rng.uniform(0, 300, 500), 1 - 10.0 ** -rng.uniform(0, 16, 500),
                                  [0, 1, .5, np.nextafter(.5, 1), -0.25, 1.5]]))
    df = spark.createDataFrame([(float(x),) for x in p], "p double")
    got = [r.b for r in df.orderBy("p").select(ordering.score_bucket(F.col("p")).alias("b")).collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


def test_areas_with_ties_and_one_class(spark):
    rng = np.random.RandomState(3)
    y = (rng.rand(400) < 0.3).astype(int)
    p = np.round(np.clip(0.3 * y + rng.rand(400), 0, 1), 1)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.5)] * 3,
                               "model string, y int, p double")
    got = {r.model: r for r in M.areas(df, ["model"]).collect()}
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > neg).mean() + .5 * (a == neg).mean() for a in pos])
    assert got["m"].roc_auc == pytest.approx(want)
    assert got["one"].roc_auc is None
    rec, prec = [0.0], [1.0]
    for t in sorted(set(p), reverse=True):
        tp, hit = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        rec.append(tp / y.sum()); prec.append(tp / hit)
    area = sum((rec[i] - rec[i - 1]) * (prec[i] + prec[i - 1]) / 2 for i in range(1, len(rec)))
    assert got["m"].pr_auc == pytest.approx(area)


def test_variance_filter_drops_infinite_and_constant(spark):
    df = spark.createDataFrame([(float(i), 1.0, float("inf") if i == 3 else 1.0 * i) for i in range(9)],
                               "a double, b double, c double")
    assert kept_features(df, ["a", "b", "c"]) == ["a"]


def test_column_rules(spark):
    cols = ["Flow ID", "Timestamp", "Dst Port", "flow_label_id", "Bytes", "Protocol", "Unnamed: 0"]
    assert find_label_column(cols) == "flow_label_id" and find_timestamp_column(cols) == "Timestamp"
    assert allowed_columns(cols) == ["flow_label_id", "Bytes"]
    assert allowed_columns(cols, ["flow_label_id", "Timestamp"]) == ["Bytes"]
    df = spark.createDataFrame([(1, None), (2, "x")], "Bytes int, Kind string").withColumn("day", F.lit("d"))
    row = audit_days(df, "day", ["Bytes", "Kind"]).first()
    assert row.status == "FAIL_NO_LABEL" and [(m["column"], m.missing) for m in row.missing_values] == [("Kind", 1)]


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" 2 ", 2.0), ("abc", 0.0), ("", 0.0), (None, 0.0),
                                       ("Infinity", math.inf), ("-inf", -math.inf), ("NaN", 0.0), ("1.5d", 0.0),
                                       ("1e3", 1000.0), (".5", 0.5), ("7.", 7.0)])
def test_number_coercion(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(to_number(F.col("t")).alias("x")).first().x == want


def test_one_time_format_per_file(spark):
    assert pick_format("14/02/2018 08:31:01") == "d/M/yyyy H:mm:ss"
    assert pick_format("2018-02-14 08:31:01") == "yyyy-MM-dd HH:mm:ss"
    df = spark.createDataFrame([("03/02/2018 08:31:01",), ("2018-02-14 08:31:01",), ("Timestamp",)], "t string")
    got = [r.x for r in df.select(parse_time(F.col("t"), pick_format("14/02/2018 08:31:01")).alias("x")).collect()]
    assert got == [dt.datetime(2018, 2, 3, 8, 31, 1), None, None]


def test_vector_helpers(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = df.select(l2_normalise(F.col("v")).alias("u"), min_max(F.col("v")).alias("m"),
                    first_max(F.col("v")).alias("f")).collect()
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[1].u == [0.0, 0.0]
    assert got[0].m == [0.0, 1.0] and got[1].m == [0.5, 0.5] and (got[0].f, got[1].f) == (2, 1)


def test_wide_statistics_agree_with_narrow(spark):
    names = [f"f{i}" for i in range(45)]
    rng = np.random.RandomState(0)
    rows = [(1, "train", s, st, int(st == 0), *map(float, rng.rand(45))) for s in range(3) for st in range(10)]
    df = spark.createDataFrame(rows, "day int, split string, seq long, step long, target int, "
                               + ", ".join(f"{n} double" for n in names))
    wide, narrow = W.window_stats(df, names), W.window_stats(df, names[:5])
    a = {r.seq: r for r in wide.collect()}
    for r in narrow.collect():
        for c in W.statistic_columns(names[:5]):
            assert a[r.seq][c] == pytest.approx(r[c])


def brute_bm25(docs, query):
    toks = {d: t.lower().split() for d, t in docs.items()}
    n, avg = len(docs), np.mean([len(t) for t in toks.values()])
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for d, t in toks.items():
        tf = Counter(t)
        s = sum(math.log((n - df[w] + .5) / (df[w] + .5) + 1) * tf[w] * 2.5
                / (tf[w] + 1.5 * (.25 + .75 * len(t) / avg)) for w in query.lower().split() if w in tf)
        if any(w in tf for w in query.lower().split()):
            out[d] = s
    return out


@pytest.mark.parametrize("small", [True, False])
def test_bm25_matches_brute_force_both_ways(spark, monkeypatch, small):
    rng = random.Random(2)
    words = ["the"] * 6 + [f"w{i}" for i in range(30)]
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for i in range(60)}
    queries = {0: "the the w1", 1: "w2 w3 w4 w5", 2: "nothing"}
    monkeypatch.setattr(R, "is_small", lambda df, limit=0: small)
    monkeypatch.setattr(blocks, "is_small", lambda df, limit=0: small)
    got = R.bm25_matches(spark.createDataFrame(list(queries.items()), "query_id int, text string"),
                         spark.createDataFrame(list(docs.items()), "doc_id int, text string")).collect()
    for q, text in queries.items():
        want = brute_bm25(docs, text)
        mine = {r.doc_id: r.bm25 for r in got if r.query_id == q}
        assert set(mine) == set(want)
        assert all(mine[d] == pytest.approx(want[d]) for d in want)


def test_latent_cosines_equal_a_dense_svd(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(12)]
    docs = {i: " ".join(rng.choice(words) for _ in range(8)) for i in range(15)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    model = R.fit_latent(frame)
    got = {r.doc_id: np.array(r.v) for r in R.latent_embedding(frame, model).collect()}
    grams = {d: Counter(t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])]) for d, t in docs.items()}
    vocab = sorted(set().union(*grams.values()))
    idf = {v: math.log(16 / (1 + sum(v in g for g in grams.values()))) + 1 for v in vocab}
    x = np.array([[(1 + math.log(grams[d][v])) * idf[v] if grams[d][v] else 0 for v in vocab] for d in docs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vt = np.linalg.svd(x, full_matrices=False)[2][:5]
    e = x @ vt.T
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    mine = np.array([got[d] for d in docs])
    assert np.allclose(mine @ mine.T, e @ e.T, atol=1e-6)


def test_saliency_equals_finite_differences(spark):
    model = explain.WindowModel(0.1, {"a": 0.7, "b": -0.4}, {"a": 0.3, "b": 0.2})
    rng = np.random.RandomState(1)
    x = rng.randn(10, 2)
    df = spark.createDataFrame([(1, "test", 0, i, 0, *map(float, x[i])) for i in range(10)],
                               "day int, split string, seq long, step long, target int, a double, b double")
    row = explain.score_windows(df, model).select("p", "saliency", explain.top_importances(
        F.col("saliency"), 2).alias("top")).first()

    def prob(v):
        z = 0.1 + np.mean(v[:, 0] * .7 + v[:, 0] ** 2 * .3 + v[:, 1] * -.4 + v[:, 1] ** 2 * .2)
        return 1 / (1 + np.exp(-z))
    assert row.p == pytest.approx(prob(x))
    for s in row.saliency:
        g = []
        for t in range(10):
            hi, lo = x.copy(), x.copy()
            hi[t, s.idx] += 1e-5; lo[t, s.idx] -= 1e-5
            g.append(abs(prob(hi) - prob(lo)) / 2e-5)
        assert s.importance == pytest.approx(np.mean(g), abs=1e-8)
    assert sum(t.importance for t in row.top) == pytest.approx(1.0)


def test_feature_names_are_padded(spark):
    assert explain.pad_names(["a"], 3) == ["a", "Feature_1", "Feature_2"]
    assert models.available()[:3] == ["XGBoost", "CatBoost", "LightGBM"]
    with pytest.raises(ValueError):
        models.build("none")


def test_missing_split(spark):
    labels = spark.createDataFrame([("train", 1)], "split string, y int")
    with pytest.raises(ValueError, match="val"):
        W.require_splits(W.split_summary(labels))


def test_hash_sample_larger_than_group_and_zero(spark):
    df = spark.range(50).select("id", (F.col("id") % 2).cast("int").alias("y"))
    quota = spark.createDataFrame([(0, 1000), (1, 0)], "y int, quota long")
    got = ordering.take_by_hash(df, ["y"], ["id"], quota, fv.SEED)
    assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == {0: 25}


def test_window_statistics_of_many_features_with_nulls(spark):
    """More than 40 features take the same way as few; nulls are left out, and the last step told."""
    names = [f"f{i}" for i in range(45)]
    values = [None if s in (3, 9) else float(s * s) for s in range(10)]
    rows = spark.createDataFrame([(0, "train", 0, s, 0, *[v] * 44, None) for s, v in enumerate(values)],
                                 "day int, split string, seq long, step int, target int, "
                                 + ", ".join(f"{n} double" for n in names))
    known = [v for v in values if v is not None]
    for used in (names[:2], names):
        r = W.window_stats(rows, used).first()
        assert r.f0__last is None and r.f0__max == 64.0 and r.f0__min == 0.0
        assert r.f0__mean == pytest.approx(np.mean(known)) and r.f0__std == pytest.approx(np.std(known))
    assert r.f44__mean is None and r.f44__std is None and r.f44__max is None


def test_scaler_takes_infinities_and_nan_as_zero(spark):
    from flowlens.operators.scaling import robust_params
    values = [float(i) for i in range(1, 101)] + [math.nan] * 30 + [math.inf] * 10 + [-math.inf] * 10 + [None] * 5
    got = robust_params(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).first()
    clean = np.array([v if v is not None and math.isfinite(v) else 0.0 for v in values])
    assert [got.median, got.low, got.high] == pytest.approx(list(np.quantile(clean, [.5, .05, .95])))


def test_quantiles_reach_the_infinities(spark):
    df = spark.createDataFrame([("a", v) for v in (-math.inf, 1.0, 2.0, math.inf, math.inf)], "k string, v double")
    got = {r.prob: r.q for r in ordering.exact_quantiles(df, "k", "v", (0.25, 0.5)).collect()}
    assert got == {0.25: 1.0, 0.5: 2.0}


def test_positions_without_a_crowded_minute_read_nothing_for_finer_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "order_buckets", lambda *a, **k: pytest.fail("no minute is crowded"))
    rows = [(d, dt.datetime(2024, 1, 1, 0, m % 7, m % 3), m) for d in (1, 2) for m in range(100)]
    df = spark.createDataFrame(rows, "day int, ts timestamp, id long")
    got = ordering.positional_index(df, ["day"], "ts", ["id"]).collect()
    for day in (1, 2):
        want = [r[2] for r in sorted((r for r in rows if r[0] == day), key=lambda r: (r[1], r[2]))]
        assert [r.id for r in sorted((r for r in got if r.day == day), key=lambda r: r.pos)] == want
    assert {(r.n, r.pos < 100) for r in got} == {(100, True)}


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_quantiles_look_closer_only_at_crowded_buckets(spark, monkeypatch, most):
    labels, write = [], ordering.stage
    monkeypatch.setattr(ordering, "BUCKET_ROWS", most)
    monkeypatch.setattr(ordering, "stage", lambda df, label: labels.append(label) or write(df, label))
    values = [1000.0 + i % 97 / 1000 for i in range(500)] + [-3.0] * 40
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    got = {r.prob: r.q for r in ordering.exact_quantiles(df, "k", "v", (0.05, 0.5, 0.95)).collect()}
    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in (0.05, 0.5, 0.95)}, rel=1e-14)
    assert ("quantile-parts" in labels) == (most == 5)


def test_window_statistics_filter_each_feature_once(spark):
    from flowlens.operators.windows import window_table_stats
    rows = [(1, "train", 0, 1, [1.0, None, 4.0], [2.0, 2.0, None]), (1, "train", 1, 0, [None, None, None], [0.5, 1.5, 2.5])]
    df = spark.createDataFrame(rows, "day int, split string, seq long, y int, a array<double>, b array<double>")
    out = window_table_stats(df.repartition(2), ["a", "b"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 2
    first, second = out.orderBy("seq").collect()
    assert (first.a__last, first.a__mean, first.a__max, first.a__min, first.a__std) == (4.0, 2.5, 4.0, 1.0, 1.5)
    assert first.b__last is None and first.b__mean == 2.0 and first.b__std == 0.0
    assert {second[f"a__{s}"] for s in ("last", "mean", "max", "min", "std")} == {None}


def test_sequence_model_is_fed_without_a_second_copy_of_the_windows(spark, sf_dir, monkeypatch):
    from flowlens.plans import model_queries as M
    labels, write = [], M.stage
    monkeypatch.setattr(M, "stage", lambda df, label: labels.append(label) or write(df, label))
    monkeypatch.setattr(M.models, "fit_sequence", lambda name, train, width: (None, 0.0))
    monkeypatch.setattr(M.models, "predict_sequence", lambda model, rows, name, width: rows)
    assert M.sequence_mlp(spark, sf_dir).where("split <> 'test' or size(x) <> 10").isEmpty()
    assert labels == ["window-table"]
