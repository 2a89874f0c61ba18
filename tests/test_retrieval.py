"""Blended retrieval of catalogues of every size, against the whole matrices of scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.operators import blocks, latent, retrieval as R

WORDS = ["the"] * 5 + ["of"] * 3 + [f"w{i}" for i in range(60)]


def texts_of(seed, n, longest=25):
    pick = random.Random(seed)
    return [" ".join(pick.choice(WORDS) for _ in range(pick.randrange(longest))) for _ in range(n)]


def frame(spark, texts, name):
    return spark.createDataFrame(list(enumerate(texts)), f"{name} int, text string").repartition(5)


def scaled(x):
    low, high = x.min(), x.max()
    return np.full(len(x), 0.5) if high - low < 1e-10 else (x - low) / (high - low)


def whole(docs, queries, model):
    """Best document of each query from all scores."""
    tokens = [(d or "").lower().split() for d in docs]
    tf, dl = [Counter(t) for t in tokens], [len(t) for t in tokens]
    avg, n = sum(dl) / len(dl), len(docs)
    df = Counter(t for c in tf for t in c)

    def hashed(text):
        words = (text or "").lower().split()
        return words + [" ".join(p) for p in zip(words, words[1:])]
    place = {t: i for i, t in enumerate(model.terms)}

    def vector(text):
        v = np.zeros(model.rank)
        for t, k in Counter(hashed(text)).items():
            if t in place:
                v += (1 + math.log(k)) * model.idf[place[t]] * np.array(model.components[place[t]])
        return v / (np.linalg.norm(v) or 1.0)
    vectors = np.array([vector(d) for d in docs])
    out = {}
    for q, text in enumerate(queries):
        b = np.zeros(n)
        for t, k in Counter((text or "").lower().split()).items():
            idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)
            b += [k * idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * d / avg)) if t in c else 0.0 for c, d in zip(tf, dl)]
        h = fv.LSA_WEIGHT * scaled(vectors @ vector(text)) + fv.BM25_WEIGHT * scaled(b)
        out[q] = (h, b.max() > 0)
    return out


def check(found, want):
    assert len(found) == len(want)
    for r in found:
        h, matched = want[r.query_id]
        assert r.matched == matched
        assert r.hybrid_score == pytest.approx(h.max(), abs=1e-9)
        assert h[r.doc_id] == pytest.approx(h.max(), abs=1e-9)
        assert r.hybrid_score == pytest.approx(fv.LSA_WEIGHT * r.lsa_score + fv.BM25_WEIGHT * r.bm25_score)


@pytest.mark.parametrize("n_docs", [6, 256, 1000])
@pytest.mark.parametrize("beside_blocks", [False, True])
def test_hybrid_of_any_size(spark, n_docs, beside_blocks):
    docs, queries = texts_of(1, n_docs), [*texts_of(2, 70), "", None, "no such words", "the the the"]
    catalogue, asked = frame(spark, docs, "doc_id"), frame(spark, queries, "query_id")
    index = blocks.build_blocks(catalogue, doc_rows=90)
    found = blocks.retrieve(asked, index, limit=0 if beside_blocks else 1 << 25, query_rows_=16).collect()
    check(found, whole(docs, queries, index.latent))


def test_large_sides_are_joined_without_hot_terms(spark, monkeypatch):
    monkeypatch.setattr(blocks, "is_small", lambda df, limit=0: False)
    monkeypatch.setattr(blocks, "HOT_TERM_SHARE", 1 / 40)
    docs, queries = texts_of(3, 300), texts_of(4, 40)
    index = blocks.build_blocks(frame(spark, docs, "doc_id"), doc_rows=64)
    check(blocks.retrieve(frame(spark, queries, "query_id"), index, limit=0).collect(), whole(docs, queries, index.latent))
    terms = spark.createDataFrame([(t,) for d in docs for t in d.split()], "term string")
    side = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(set(WORDS[:30])))], "term string, i int")
    joined = blocks.join_on_term(terms, side)
    want = Counter(t for d in docs for t in d.split() if t in WORDS[:30])
    assert {r.term: r["count"] for r in joined.groupBy("term").count().collect()} == dict(want)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_equal_ids_empty_catalogue_and_string_ids(spark):
    queries = spark.createDataFrame([("a", "the w1"), ("b", None)], "query_id string, text string")
    empty = frame(spark, ["x"], "doc_id").limit(0)
    assert blocks.retrieve(queries, blocks.build_blocks(empty)).collect() == []
    same = spark.createDataFrame([(7, "the w1"), (7, "the w1"), (3, "the w1")], "doc_id long, text string")
    for limit in (0, 1 << 25):
        found = blocks.retrieve(queries, blocks.build_blocks(same), limit=limit).collect()
        assert sorted((r.query_id, r.doc_id, r.hybrid_score, r.matched) for r in found) == [("a", 3, 0.5, True), ("b", 3, 0.5, False)]


def test_lexical_half_beyond_the_limit(spark, monkeypatch):
    docs, queries = texts_of(5, 120), texts_of(6, 30)
    catalogue, asked = frame(spark, docs, "doc_id"), frame(spark, queries, "query_id")
    small = {tuple(r) for r in R.bm25_best(asked, catalogue).collect()}
    monkeypatch.setattr(R, "CATALOGUE_LIMIT", 50)
    assert {tuple(r) for r in R.bm25_best(asked, catalogue).collect()} == small


def test_vectors_beyond_the_limit(spark, monkeypatch):
    draw = np.random.default_rng(3)
    catalogue = spark.createDataFrame([(i, draw.normal(size=4).tolist()) for i in range(90)] + [(90 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)],
                                      "label int, v array<double>")
    queries = spark.createDataFrame([(i, draw.normal(size=4).tolist()) for i in range(40)] + [(40, [2.0, 0.0, 0.0, 0.0]), (41, [0.0] * 4)],
                                    "query_id int, v array<double>")
    nearest = {tuple(r) for r in R.nearest_in_catalogue(queries, catalogue).collect()}
    cells = {(r.query_id, r.label, round(r.cosine, 9)) for r in R.cosine_to_catalogue(queries, catalogue).collect()}
    monkeypatch.setattr(R, "CATALOGUE_LIMIT", 20)
    assert {tuple(r) for r in R.nearest_in_catalogue(queries, catalogue).collect()} == nearest
    assert {(r.query_id, r.label, round(r.cosine, 9)) for r in R.cosine_to_catalogue(queries, catalogue).collect()} == cells
    assert len(cells) == 42 * 95 and (40, 90, 1.0) in nearest


def test_latent_model_of_texts_without_words(spark):
    model = latent.fit_latent(frame(spark, ["", "  ", "!?"], "doc_id"))
    assert model.rank == 0
    assert [r.v for r in latent.latent_embedding(frame(spark, ["the"], "doc_id"), model).collect()] == [[]]


def test_directions_equal_those_of_a_dense_svd(spark):
    docs = texts_of(8, 40)
    model = latent.fit_latent(frame(spark, docs, "doc_id"))
    grams = [Counter(t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])]) for t in docs]
    x = np.array([[(1 + math.log(g[t])) * idf if g[t] else 0.0 for t, idf in zip(model.terms, model.idf)] for g in grams])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    v = np.linalg.svd(x, full_matrices=False)[2][:5].T
    assert np.allclose(np.abs((v * np.array(model.components)).sum(axis=0)), 1.0, atol=1e-8)
    assert all(c[np.abs(c).argmax()] > 0 for c in np.array(model.components).T)


class Counting:
    """A latent model that notes how many texts it is given at once."""
    def __init__(self):
        self.most = 0

    def embed(self, grams):
        self.most = max(self.most, len(grams))
        return np.zeros((len(grams), 2))


def test_python_holds_few_texts_of_a_batch_at_once():
    import pyarrow as pa
    lists = pa.array([[i, i + 1, i] for i in range(1500)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), lists, lists], names=["doc_id", "t", "g"])
    model = Counting()
    made = list(blocks._doc_blocks(model, 1024, 1 << 17)([batch]))
    assert model.most <= latent.BATCH_TEXTS
    assert [len(b.column("ids")[0]) for b in made] == [1024, 476]
    block = blocks._block_of(made[1], 0)
    assert block.ids.tolist() == list(range(1024, 1500)) and block.vectors.shape == (476, 2)
    assert sorted(zip(block.places.tolist(), block.terms.tolist(), block.tf.tolist()))[:2] == [(0, 1024, 2), (0, 1025, 1)]


def test_scores_are_the_same_however_few_entries_are_met_at_once(monkeypatch):
    draw = np.random.default_rng(3)
    terms = np.sort(draw.integers(0, 9, 200))
    block = blocks.DocBlock(np.arange(40), terms, draw.integers(0, 40, 200), draw.integers(1, 4, 200), np.full(40, 9), np.zeros((40, 0)))
    sizes = draw.integers(0, 6, 30)
    query = (blocks._starts(sizes), draw.integers(0, 12, sizes.sum()), draw.random(sizes.sum()))
    whole_ = block.bm25(*query, 9.0)
    monkeypatch.setattr(blocks, "SCORED_ENTRIES", 7)
    made, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *rest: made.append(len(x)) or plain(x, *rest))
    assert (block.bm25(*query, 9.0) == whole_).all()
    assert len(made) > 10 and whole_.any()


@pytest.mark.parametrize("limit", [1, 3, 6, 50])
def test_vocabulary_equals_counts_of_all_words_and_pairs(spark, limit):
    texts = ["a b a b c", "b a b", "d", "", None, "c c c c", "a b e f", "x y x y x y"]
    counts = Counter()
    for t in texts:
        w = (t or "").split()
        counts.update(w)
        counts.update(f"{p} {q}" for p, q in zip(w, w[1:]))
    want = sorted(counts.items(), key=lambda i: (-i[1], i[0]))[:limit]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r) for r in R.vocabulary(docs, limit).orderBy(F.desc("total"), "term").collect()] == want


def test_tfidf_splits_each_text_once(spark, sf_dir):
    from flowlens.plans.text_queries import tfidf
    assert "regexp_extract_all" not in tfidf(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
