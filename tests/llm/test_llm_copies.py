"""Near copies against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import near_copies
from flowlens.llm.simhash import fingerprint

from .helpers import WORDS, awkward_rows, docs_of, prose, rows_of


def plain_set(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def naive_groups(rows, similarity=0.8):
    """Every pair of rows compared; the group of a row is its least id."""
    sets, fps = [plain_set(t) for _, t in rows], [fingerprint(t) & (1 << 64) - 1 for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            alike = common and common / (len(sets[i]) + len(sets[j]) - common) >= similarity
            if (alike or (fps[i] ^ fps[j]).bit_count() <= 2) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), doc_id) if x is not None), default=None)
    return sorted(((d, least[g]) for (d, _), g in zip(rows, group)), key=repr)


def edited(text, edits, pick):
    words = text.split(" ")
    for _ in range(edits):
        words[pick.randrange(len(words))] = pick.choice(WORDS) + str(pick.randrange(10**6))
    return " ".join(words)


@pytest.mark.parametrize("crowd", [128, 2])
def test_groups_are_those_of_all_pairs(spark, crowd):
    pick, rows = random.Random(5), []
    for g in range(12):
        base = prose(900 + g, 90 + 40 * g)
        rows += [(1000 + len(rows) + i, edited(base, pick.randrange(12) if i else 0, pick)) for i in range(14)]
    rows += [(d, t) for d, t, *_ in awkward_rows()]
    docs = docs_of(spark, [(d, t, None, None, None) for d, t in rows], extra=True)
    want = naive_groups(rows)
    # a crowded block links through leaders; these groups hang together by their other blocks
    assert rows_of(near_copies.near_copies(docs, crowd=crowd)) == want
    kept = near_copies.drop_near_copies(docs, crowd=crowd)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want if c is not None})


def test_copies_at_the_threshold_and_below(spark):
    words = [f"w{i}" for i in range(94)]                        # 90 shingles
    at = words[:47] + ["x"] + words[48:]                        # 85 common of 95
    apart = [w if i % 12 else "x" for i, w in enumerate(words)]
    rows = [(1, words), (2, at), (3, apart), (4, ["W%d" % i for i in range(94)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = dict(rows_of(near_copies.near_copies(docs)))
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    exact = 85 / 95
    assert dict(rows_of(near_copies.near_copies(docs, similarity=exact, radius=0)))[2] == 1
    assert dict(rows_of(near_copies.near_copies(docs, similarity=exact + 1e-9, radius=0)))[2] == 2


def test_equal_sets_with_other_repeats_and_empty_tables(spark):
    once = " ".join(f"a{i % 9}" for i in range(30))
    docs = spark.createDataFrame([(7, once), (3, once + " " + " ".join(f"a{(30 + i) % 9}" for i in range(200))), (None, None)],
                                 "doc_id long, text string")
    assert rows_of(near_copies.near_copies(docs, radius=0)) == [(3, 3), (7, 3), (None, None)]
    assert near_copies.near_copies(docs.limit(0)).count() == near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_block_keys_meet_at_the_similarity():
    pick, met = random.Random(1), 0
    for _ in range(300):
        base = [pick.getrandbits(64) for _ in range(190)]
        import numpy as np
        a, b = (np.unique(np.array(base[x:x + 171], dtype=np.uint64)) for x in (0, 19))   # 152 common of 190: 0.8
        met += any(x == y for x, y in zip(near_copies.block_keys(a), near_copies.block_keys(b)))
    assert met >= 298


def bridged(group):
    """Two crowds of texts in one group's words, tied by a single pair at 0.97; all share most of their blocks."""
    return [" ".join(f"{group}{k}" for k in range(i, i + 1004)) for i in (*range(13), *range(27, 40))]


@pytest.mark.parametrize("most_tiles", [near_copies.MOST_TILES, 100])
def test_the_only_link_between_two_crowds_is_found(spark, monkeypatch, most_tiles):
    monkeypatch.setattr(near_copies, "MOST_TILES", most_tiles, raising=False)
    rows = [(100 * g + i, t) for g in range(4) for i, t in enumerate(bridged("abcd"[g]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = near_copies._prints(docs).withColumn("keys", F.array(F.lit(1).cast("bigint")))     # one block of all
    group = {r.fp: r.id // 100 for r in prints.collect()}
    root = {p: p for p in group}
    for u, v in near_copies.similar_prints(docs, prints, 0.97, crowd=2).collect():
        root = {p: root[u] if r == root[v] else r for p, r in root.items()}
    assert len(set(root.values())) == 4 and all(group[p] == group[r] for p, r in root.items())


@pytest.mark.parametrize("seed", range(6))
def test_links_of_a_tile_are_those_of_all_pairs(seed):
    pick = np.random.default_rng(seed)
    sets = []
    for base in range(4):
        own = pick.integers(0, 1 << 60, 60)
        for _ in range(12):
            sets.append(np.unique(np.concatenate([own[pick.random(60) > 0.12], pick.integers(0, 1 << 60, pick.integers(0, 6))])))
    group = np.unique(pick.integers(0, 40, len(sets)), return_inverse=True)[1]

    def joined(links):
        root = group.copy()
        for i, j in links:
            root[root == root[i]] = root[j]
        return {tuple(np.flatnonzero(root == r)) for r in root}

    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    every = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
    found = near_copies.spanning_links(sets, group, 0.8)
    assert set(map(lambda p: (max(p), min(p)), found)) <= set(every) and joined(found) == joined(every)
