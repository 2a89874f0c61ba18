"""Hard negatives: packed products against plain ones, the query against brute force."""

import math
import random

import numpy as np
import pytest

from flowlens.llm import hard_negatives as hn

from .helpers import rows_of


@pytest.mark.parametrize("most", [1, 300, 40_000, 1 << 40])
def test_packed_products_are_exact(most):
    pick = random.Random(most)
    vectors = [[pick.randint(-most, most) for _ in range(pick.choice((0, 3, 7)))] for _ in range(50)]
    bias = most + 1
    block = hn.pack(vectors, 2 * bias)
    for _ in range(10):
        anchor = [pick.randint(-most, most) for _ in range(pick.choice((0, 5, 9)))]
        assert hn.products(block, anchor, bias).tolist() == [sum(a * x for a, x in zip(anchor, v)) for v in vectors]


def plain_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, u, own in kept:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), i, label) for i, v, label in kept)
        positives = [(-s, i) for s, i, label in scored if label == own and i != a][:5]
        for ps, p in positives:
            hits = [(-s, i) for s, i, label in scored if label != own and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i) in enumerate(hits)]
    return sorted(out, key=repr)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_negatives_equal_brute_force(spark):
    pick = random.Random(3)
    rows = [(i, [pick.uniform(-1, 1) + 0.4 for _ in range(6)], pick.randrange(3)) for i in range(0, 900, 3)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(30)]  # ties, among them an anchor
    rows += [(2001, None, 1), (2002, [0.1, None, 0.2], 1), (2100, [float("nan")] * 6, 2), (2003, rows[1][1], None),
             (None, rows[2][1], 1), (2200, [float("-inf")] + [0.0] * 5, 0), (2300, [], 1), (2301, [0.5, 0.5], 0)]
    rows += [rows[7], rows[7]]
    pick.shuffle(rows)
    frame = vectors_of(spark, rows)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for blocks in ({}, {"block_rows": 17, "group_rows": 2}):
        from pyspark.sql import functions as F
        out = hn.mine_hard_negatives(frame.withColumn("no", F.lit("x")).withColumn("group", F.lit("y")), **blocks)
        assert out.columns == names
        assert rows_of(out) == plain_negatives(rows)


def test_tables_without_anchors(spark):
    assert hn.mine_hard_negatives(vectors_of(spark, [])).collect() == []
    assert hn.mine_hard_negatives(vectors_of(spark, [(1, [0.5], 1), (2, [0.5], 2)])).collect() == []
    assert hn.mine_hard_negatives(vectors_of(spark, [(100, [0.5], 1)])).collect() == []
