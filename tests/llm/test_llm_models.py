"""The two fitted models against plain recomputation: posteriors of sites, and the penalised loss."""

import collections
import math

import numpy as np
import pytest

from flowlens.llm import quality_model, toxicity

from .helpers import awkward_rows, docs_of, prose


def plain_strength(groups, low, high):
    """Method of moments over (n, s, prior) of groups."""
    n = sum(g[0] for g in groups)
    between = sum(m * ((s / m - q) ** 2 - q * (1 - q) / m) for m, s, q in groups) / n
    within = sum(m * q * (1 - q) for m, _, q in groups) / n
    return min(max(within / max(between, 1e-9) - 1, low), high) if within else high


def test_posteriors_are_those_of_the_formula(spark):
    rows = [(i, prose(i, 20 + 11 * (i % 9)) if i % 4 else "x " * (i + 1), ("en", "de", None)[i % 3], (f"site{i % 4}", None, "big", "big")[i % 4], None)
            for i in range(140)] + awkward_rows()
    rows = [r for r in rows if r[0] is not None]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(100)], "doc_id long, quality int")
    out = quality_model.judged(docs_of(spark, rows), labels, ["doc_id", "lang", "source"]).collect()
    assert len(out) == len(rows)
    site = lambda r: r["__row"]["source"]
    path = lambda r: (r["__row"]["source"], r["__row"]["lang"])
    hosts, paths = (collections.defaultdict(lambda: [0, 0.0]) for _ in range(2))
    for r in out:
        for table, key in ((hosts, site(r)), (paths, path(r))):
            table[key][0] += 1
            table[key][1] += r.evidence
    rate = sum(s for _, s in hosts.values()) / len(out)
    low, high = quality_model.STRENGTH
    k = plain_strength([(n, s, rate) for n, s in hosts.values()], low, high)
    posterior = {h: (k * rate + s) / (k + n) for h, (n, s) in hosts.items()}
    k = plain_strength([(n, s, posterior[h]) for (h, _), (n, s) in paths.items()], low, high)
    for r in out:
        n, s = paths[path(r)]
        own = min(max((k * posterior[site(r)] + s - r.evidence) / (k + n - 1), 1e-6), 1 - 1e-6)
        odds = lambda x: x / (1 - x)
        joint = odds(min(max(r.evidence, 1e-6), 1 - 1e-6)) * odds(own) / odds(rate)
        assert r.site_rate == pytest.approx(posterior[site(r)], rel=1e-9)
        assert r.path_rate == pytest.approx(own, rel=1e-9)
        assert r.score == pytest.approx(joint / (1 + joint), rel=1e-9)


def test_evidence_is_at_the_least_loss():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, len(quality_model.FEATURES))) * draw.uniform(0.5, 20, len(quality_model.FEATURES))
    y = (x[:, 0] / x[:, 0].std() + draw.normal(size=300) > 0).astype(float)
    e = quality_model.fit_evidence(x, y)
    v = np.clip((x - np.array(e.mean)) / np.array(e.spread), -8, 8)
    a = np.column_stack([v, v * v, np.ones(300)])
    w = np.append(e.weights, e.bias)
    p = 1 / (1 + np.exp(-a @ w))
    pull = quality_model.RIDGE * 300 * np.append(w[:-1], 0.0)
    assert np.abs(a.T @ (p - y) + pull).max() < 1e-4


@pytest.mark.parametrize("penalty", [0.0, 1.0, 25.0])
def test_penalised_loss_is_the_least(penalty):
    """Against plain gradient descent, and against every small step away."""
    draw = np.random.default_rng(int(penalty))
    size, n = 9, 60
    rows = [np.flatnonzero(draw.random(size) < 0.4).astype(np.int64) for _ in range(n)]
    labels = np.array([float((0 in r) + draw.random() > 0.9) for r in rows])
    swapped = [[np.unique(draw.integers(0, size, 3))] if i % 3 == 0 else [] for i in range(n)]
    ridge = 0.01
    weights, bias = toxicity.fit_logistic(rows, labels, swapped, size, ridge, penalty, 200)
    share = labels.mean()
    pairs = [(i, s) for i, others in enumerate(swapped) for s in others]

    def loss(v):
        out = ridge * sum(x * x for x in v[:-1]) / 2 + 1e-9 * v[-1] ** 2 / 2
        for r, y in zip(rows, labels):
            z = sum(v[j] for j in r) + v[-1]
            out += (0.5 / share if y else 0.5 / (1 - share)) / n * (math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z)
        return out + penalty / len(pairs) * sum((sum(v[j] for j in rows[i]) - sum(v[j] for j in s)) ** 2 for i, s in pairs)

    found = np.append(weights, bias)
    least = loss(found)
    for j in range(size + 1):
        for step in (1e-3, -1e-3):
            moved = found.copy()
            moved[j] += step
            assert loss(moved) > least
    v, rate = np.zeros(size + 1), 0.5 / (1 + penalty)
    slope = lambda v: np.array([(loss(v + d) - loss(v - d)) / 2e-5 for d in np.eye(size + 1) * 1e-5])
    for _ in range(400):
        v = v - rate * slope(v)
    assert least <= loss(v) + 1e-9
    if penalty:
        plain, b = toxicity.fit_logistic(rows, labels, swapped, size, ridge, 0.0, 200)
        change = lambda w: sum((w[rows[i]].sum() - w[s].sum()) ** 2 for i, s in pairs)
        assert change(weights) < change(plain)


def test_a_shard_is_summed_in_parts_of_its_hash_range(tmp_path):
    """The same file and sums as all at once, and far less memory than a copy of everything for every step."""
    import tracemalloc

    import pyarrow as pa

    from flowlens.llm import kneser_ney as k
    draw = np.random.default_rng(1)
    words = np.sort(draw.integers(0, 1 << 63, 3000, dtype=np.uint64))
    pairs = [k._merged(*(words[draw.integers(0, 3000, 60_000)] for _ in range(2)), np.ones(60_000, np.int64)) for _ in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 8, pa.int32()), pa.array([k.pack(*p) for p in pairs], pa.binary())], names=["shard", "pairs"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(k._write_pairs(str(tmp_path), 0)([batch])))
    assert tracemalloc.get_traced_memory()[1] < 80 * sum(len(p[0]) for p in pairs)
    tracemalloc.stop()
    first, second, n = k._merged(*map(np.concatenate, zip(*pairs)))
    written = k.HashArrays(str(tmp_path), 0, 1, frozenset([0]))
    assert (written.find(k.pair_keys(first, second))[0] == n).all() and k.written_shards(str(tmp_path)) == {0: len(n)}
    assert found["word"].to_numpy().view(np.uint64).tolist() == words.tolist()
    assert found["count"].to_numpy().sum() == found["total"].to_numpy().sum() == n.sum()
    assert found["before"].to_numpy().sum() == len(n)
