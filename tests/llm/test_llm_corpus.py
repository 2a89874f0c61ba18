"""Near-duplicates, mixing, decontamination, models and the pipeline against plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import components, decontaminate, kneser_ney, mixing, quality_model, simhash, toxicity

from .helpers import awkward_rows, docs_of, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- near-duplicates

def plain_fingerprint(text, width=3):
    words = WORD.findall(lower(text))
    runs = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_near_duplicates(rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = plain_components(ids, links)
    return {(i, f"{prints[i]:016x}", roots[i]) for i in ids}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_near_duplicates_equal_all_pairs(spark, sf_dir, crowd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_near_duplicates([(r.doc_id, r.text) for r in docs.collect()])
    assert {tuple(r) for r in simhash.near_duplicates(docs, crowd=crowd).collect()} == want


@pytest.mark.parametrize("crowd", [1, 3, 500])
def test_links_of_crowded_blocks(spark, crowd):
    """Clusters of fingerprints around few centres: every crowd size gives the components of all pairs."""
    pick, prints = random.Random(5), set()
    for _ in range(6):
        centre = pick.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(pick.randrange(5)):
                x ^= 1 << pick.randrange(64)
            prints.add(x - (1 << 64) if x >> 63 else x)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in prints], "fp long"), crowd=crowd).collect()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(apart(*r) <= 2 for r in links)
    every = [(a, b) for a in prints for b in prints if a < b and apart(a, b) <= 2]
    assert plain_components(prints, [tuple(r) for r in links]) == plain_components(prints, every)


@pytest.mark.parametrize("crowd", [1, 2, 48])
@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_of_every_radius(spark, radius, crowd):
    pick = random.Random(radius)
    prints = {15, 14, 12, 11, 0, 1 << 62, *(pick.getrandbits(3) << 40 | 7 for _ in range(9)), *(1 << pick.randrange(9) | 255 << 20 for _ in range(7))}
    links = simhash.near_links(spark.createDataFrame([(x,) for x in prints], "fp long"), radius=radius, crowd=crowd).collect()
    every = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius]
    assert {tuple(r) for r in links} <= {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= max(radius, 0)}
    assert plain_components(prints, [tuple(r) for r in links]) == plain_components(prints, every)


def with_odd_names(docs):
    for name in ("__rank", "__r", "__n", "__text", "a.b", "c0", "c5", "w`x"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


def test_stages_keep_columns_of_any_name(spark):
    docs = with_odd_names(docs_of(spark, awkward_rows()))
    items = spark.createDataFrame([(1, awkward_rows()[3][1])], "item_id int, text string")
    for out in (simhash.drop_near_duplicates(docs), decontaminate.drop_leaks(docs, items)):
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == tuple(docs.columns[5:]) for r in rows)


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "smallint", "decimal(9,0)"])
def test_item_ids_of_any_type(spark, kind):
    rows = [r for r in awkward_rows() if r[0] == 3]
    items = spark.createDataFrame([(7, rows[0][1]), (8, "nothing of the kind")], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    out = decontaminate.find_leaks(docs_of(spark, rows), items)
    assert out.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert [str(r.item_id) for r in out.collect()] == ["7"] * len(rows)


def test_near_duplicates_of_awkward_rows(spark):
    rows = [r for r in awkward_rows() if r[0] is not None]
    out = simhash.near_duplicates(docs_of(spark, awkward_rows(), extra=True))
    assert out.count() == len(awkward_rows())
    found = {tuple(r) for r in out.where("doc_id is not null").collect()}
    want = plain_near_duplicates([(r[0], r[1]) for r in rows])
    assert found == want
    assert {r.fingerprint for r in out.where("doc_id in (100, 101, 102)").collect()} == {"0" * 16}
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = awkward_rows()
    docs = docs_of(spark, rows, extra=True)
    stay = simhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
    out = stay.collect()
    assert len(out) == groups
    ids = {r[2] for r in plain_near_duplicates([(r[0], r[1]) for r in rows if r[0] is not None])}
    assert {r.doc_id for r in out} - {None} == ids
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(150, 150)] + [(7, 3)]
    nodes = {x for a, b in links for x in (a, b) if a != b}
    out = components.connected_components(spark.createDataFrame(links, "u long, v long"))
    assert {r.node: r.root for r in out.collect()} == plain_components(nodes, [p for p in links if p[0] != p[1]])
    assert out.count() == len(nodes)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- mixing

def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target = sum(sizes.values()), {}
    free = list(order)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        stop = [s for s in free if level * weight[s] >= 3 * sizes[s]]
        if not stop:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in stop}
        free = [s for s in free if s not in stop]
    return target


def check_mix(out, rows):
    sizes = collections.Counter()
    for i, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets, taken = plain_targets(sizes), collections.Counter()
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return targets, taken


def test_targets_by_water_filling():
    assert plain_targets({"a": 1, "b": 1000, "c": 1000}) == {"a": 3.0, "b": pytest.approx(799.2), "c": pytest.approx(1198.8)}


def test_mix_of_the_table_meets_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    out = mixing.mix_sources(docs)
    rows = [tuple(r) for r in docs.collect()]
    targets, taken = check_mix(out.collect(), rows)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(30, 0.02 * target), source
    assert rows_of(out) == rows_of(mixing.mix_sources(docs.repartition(13)))  # reruns agree


def test_mix_of_awkward_rows(spark):
    rows = awkward_rows() + [(400 + i, "same length of words here", "en", "hot", None) for i in range(500)]
    docs = docs_of(spark, rows).withColumn("size", F.lit("clash")).withColumn("part", F.lit("clash"))
    targets, taken = check_mix(mixing.mix_sources(docs).collect(), rows)
    assert abs(taken["hot"] - targets["hot"]) <= 5
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    blank = docs_of(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])
    assert [r.taken for r in mixing.mix_sources(blank).collect()] == [0, 0]


def test_subset_sum_is_the_best():
    pick = random.Random(2)
    for _ in range(150):
        sizes = np.array(sorted(pick.sample(range(12), pick.randrange(1, 6))))
        counts = np.array([pick.randrange(4) for _ in sizes])
        budget = pick.randrange(40)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        taken = mixing.subset_sum(sizes, counts, budget)
        assert (taken <= counts).all() and (taken * sizes).sum() == max(x for x in sums if x <= budget)


# ---------------------------------------------------------------- decontamination

def plain_leaks(rows, items):
    strip = lambda t: re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").lower()).split()
    bag = lambda w, k: collections.Counter(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for doc, text in rows:
        words = strip(text)
        for item, body in items:
            want = strip(body)
            k = min(5, len(want))
            if not want:
                continue
            b = bag(want, k)
            best = 0.0
            for s in range(len(words) - len(want) + 1):
                a = bag(words[s:s + len(want)], k)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[doc, item] = pytest.approx(best)
    return out


def test_leaks_equal_brute_force(spark):
    pick = random.Random(9)
    items = [(k, prose(900 + k, n).replace("\n", " ")) for k, n in enumerate((12, 18, 30, 45, 60, 6, 3, 5))] + [(50, None), (51, ""), (52, "!!")]
    rows = [(i, prose(i, 70)) for i in range(12)] + [(90, None), (91, ""), (None, items[1][1])]
    for k, (item, body) in enumerate(items[:8]):
        words = body.split()
        near = words[:]
        near[len(near) // 2] = "changed"
        drop = words[:]
        del drop[pick.randrange(len(drop))]
        rows += [(100 + k, prose(40 + k, 50) + " " + body.upper() + " " + prose(60 + k, 30)), (120 + k, prose(k, 20) + " " + " ".join(near)),
                 (140 + k, " ".join(drop) + "\n" + prose(70 + k, 44)), (160 + k, prose(3, 30) + " " + " ".join(words[:len(words) // 2]))]
    rows.append((200, prose(1, 20_000) + " " + items[4][1] + " " + prose(2, 9_000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_leaks(docs, bench).collect()
    short = [r for r in rows if r[0] != 200]
    assert {(r.doc_id, r.item_id): r.similarity for r in out if r.doc_id != 200} == plain_leaks(short, items)
    assert {(r.item_id, r.similarity, r.start_word) for r in out if r.doc_id == 200 and r.item_id == 4} == {(4, 1.0, 20_000)}
    clean = decontaminate.drop_leaks(docs, bench)
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _ in rows if i not in {r.doc_id for r in out})
    assert clean.columns == docs.columns
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_texts_shorter_than_an_item_are_compared_whole(spark):
    """Cut at either end, word by word: the whole text against the item by all its shingles."""
    item = prose(7, 59).split()
    cuts = {n: item[n:] for n in range(1, 20)} | {100 + n: item[:-n] for n in range(1, 20)} | {200: item[3:-4], 201: item[1:4], 202: item}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in cuts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, prose(8, 40))], "item_id long, text string")
    plain = lambda w: re.sub(r"[!-/:-@\[-`{-~]", "", " ".join(w).lower()).split()
    bag = lambda w: collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    same = {i: sum((bag(plain(w)) & bag(plain(item))).values()) / sum((bag(plain(w)) | bag(plain(item))).values()) for i, w in cuts.items()}
    want = {(i, 1): (pytest.approx(s), 0, len(cuts[i])) for i, s in same.items() if s >= 0.8}
    assert len(want) > 20
    out = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in out} == want
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {i for i, s in same.items() if s < 0.8}


def test_blocks_miss_no_close_fingerprint():
    pick = random.Random(1)
    index = decontaminate.SizeIndex(5, 5, 1, [0] * 40, [[b"w"] * 5] * 40)
    index.close(20)
    index.prints = np.array([pick.getrandbits(64) for _ in range(40)], dtype=np.uint64)
    index.blocks = []
    edges = [64 * i // 21 for i in range(22)]
    for a, b in zip(edges, edges[1:]):
        value = (index.prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(value, kind="stable")
        index.blocks.append((a, b, order, value[order]))
    flips = [sum(1 << b for b in pick.sample(range(64), pick.randrange(30))) for _ in range(200)]
    probes = np.array([int(index.prints[i % 40]) ^ f for i, f in enumerate(flips)], dtype=np.uint64)
    w, i, _ = index.within(probes, 20)
    want = {(a, b) for a, x in enumerate(probes) for b, y in enumerate(index.prints) if int(x ^ y).bit_count() <= 20}
    assert set(zip(w.tolist(), i.tolist())) == want


# ---------------------------------------------------------------- models

def test_quality_model_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 2 = 0")
    out = quality_model.classify_quality(docs, fit).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r.kept for r in out if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_sparse_sites_lean_on_the_prior(spark):
    """One bad document on a small site moves it less than many on a large one."""
    bad, good = "buy ### now $$$ | " * 30, prose
    rows = [(i, bad if i < 190 else good(i, 100), "en", "big", None) for i in range(200)]
    rows += [(1000, bad, "en", "small", None)] + [(2000 + i, good(i, 100), "en", f"other{i % 20}", None) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i >= 190), 0) for i, *_ in rows if i % 2 == 0 and i != 1000], LABELS)
    out = {r.doc_id: r for r in quality_model.classify_quality(docs_of(spark, rows), labels).collect()}
    assert out[0].site_rate < 0.3 < out[1000].site_rate and out[0].path_rate < out[1000].path_rate < out[2000].path_rate + 0.2
    assert not out[0].kept and not out[1000].kept and out[2000].kept


def test_quality_model_of_awkward_rows(spark):
    rows = awkward_rows()
    docs = docs_of(spark, rows, extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (4, 0, 0), (999, 1, 1)], LABELS)
    out = quality_model.classify_quality(docs, labels)
    assert out.count() == len(rows) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_model.keep_good(docs, labels).columns == docs.columns
    assert quality_model.classify_quality(docs, labels.limit(0)).count() == len(rows)
    assert quality_model.classify_quality(docs.limit(0), labels).count() == 0


def test_host_and_path_of_urls(spark):
    rows = [("https://u@News.example.org:80/sport/x?y", "en"), ("src1", "de"), ("http://a.b", None), (None, None)]
    df = spark.createDataFrame(rows, "source string, lang string")
    out = df.select(*quality_model.site_of(F.col("source"), F.col("lang"))).collect()
    assert [tuple(r) for r in out] == [("news.example.org", "sport"), ("src1", "de"), ("a.b", ""), (None, None)]


def test_toxicity_on_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    out = toxicity.toxic_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit, false = (np.mean([r.predicted for r in out if r.toxic == t]) for t in (1, 0))
    assert hit > 0.85 and false < 0.01
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out)


def test_swapped_terms_lose_their_weight(spark):
    """A group is named in toxic rows only; with the penalty its name alone stops counting."""
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((i, prose(i, 30) + (" the muslims are worthless scum" if toxic else " a calm day"), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, LABELS)
    neutral = "many muslims live in the quiet old town and walk to the market"
    fit = lambda penalty: toxicity.train(docs, marks, F.lit(True), penalty=penalty)
    plain, fair = fit(0.0), fit(5.0)
    assert plain.weights[b"muslims"] > 1 and abs(fair.weights[b"muslims"]) < 0.3 * plain.weights[b"muslims"]
    assert fair.score(neutral) < plain.score(neutral) and fair.score(neutral) < 0.5
    assert fair.score("you worthless scum") > 0.7


def test_toxicity_of_awkward_rows(spark):
    docs = docs_of(spark, awkward_rows(), extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (4, 0, 0), (999, 1, 1)], LABELS)
    for marks in (labels, labels.limit(0), labels.where("toxic = 0")):
        out = toxicity.toxic_documents(docs, marks).collect()
        assert len(out) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert toxicity.toxic_documents(docs.limit(0), labels).count() == 0


# ---------------------------------------------------------------- language model

def plain_kneser_ney(train, texts):
    """Interpolated modified Kneser-Ney over dictionaries of words."""
    tokens = lambda t: [*WORD.findall(lower(t)), "</end>"]
    pairs, count = collections.Counter(), collections.Counter()
    for t in train:
        ws = tokens(t)
        count.update(ws)
        pairs.update(zip(["<start>", *ws], ws))
    before = collections.Counter(w for _, w in pairs)
    n = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]

    def cuts(c):
        a = n(c)
        if min(a) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = a[0] / (a[0] + 2 * a[1])
        return [0, 1 - 2 * y * a[1] / a[0], 2 - 3 * y * a[2] / a[1], 3 - 4 * y * a[3] / a[2]]
    d2, d1 = cuts(pairs), cuts(before)
    v, types, total = len(count), len(pairs), sum(count.values())
    rest1 = sum(d1[min(x, 3)] for x in before.values()) / types if types else 1.0
    after = collections.defaultdict(list)
    for (a, _), x in pairs.items():
        after[a].append(x)
    out = []
    for t in texts:
        ws, score, base, known = tokens(t), 0.0, 0.0, 0
        for a, w in zip(["<start>", *ws], ws):
            p = max(before[w] - d1[min(before[w], 3)], 0) / max(types, 1) + rest1 / (v + 1)
            if a in after:
                s = sum(after[a])
                p = max(pairs[a, w] - d2[min(pairs[a, w], 3)], 0) / s + sum(d2[min(x, 3)] for x in after[a]) / s * p
            score += math.log10(p)
            base += math.log10((count[w] + 0.5) / (total + 0.5 * (v + 1)))
            known += w in count
        out.append((len(ws), known, total, base, score))
    return out


def check_scores(out, rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    want = plain_kneser_ney([t for i, t in rows if not held(i)], [t for _, t in rows])
    want = sorted(((i, held(i), *w) for (i, _), w in zip(rows, want)), key=lambda r: (repr(r[:5]), r[5]))
    got = sorted((tuple(r) for r in out), key=lambda r: (repr(r[:5]), r[5]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_equal_the_formula(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_scores(kneser_ney.score_corpus(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_scores_of_awkward_rows_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 4096)
    rows = awkward_rows()
    out = kneser_ney.score_corpus(docs_of(spark, rows, extra=True)).collect()
    check_scores(out, [(r[0], r[1]) for r in rows])
    assert kneser_ney.score_corpus(docs_of(spark, rows).limit(0)).count() == 0


def test_one_shard_is_written_by_one_task(spark, monkeypatch):
    """However many partitions there are."""
    frame = type(spark.range(0))
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: deal(self, max(n, 13), *cols) if cols else deal(self, n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = awkward_rows()
        check_scores(kneser_ney.score_corpus(docs_of(spark, rows)).collect(), [(r[0], r[1]) for r in rows])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = kneser_ney.score_corpus(docs_of(spark, [(held, "a b c", "en", "s", None)])).collect()[0]
    assert tuple(r)[1:] == (True, 4, 0, 0, 0.0, 0.0)


def test_missing_arrays_are_an_error(spark, tmp_path):
    import os
    docs = docs_of(spark, [(None, prose(i, 60), "en", "s", None) for i in range(3)])
    model = kneser_ney.train(docs)
    for kind in ("pairs", "words"):
        name = kneser_ney._file(f"{model.folder}/{kind}", 0)
        os.rename(name, f"{name}.away")
        with pytest.raises(FileNotFoundError):
            model.score([kneser_ney.token_hashes("the of")], model.arrays())
        os.rename(f"{name}.away", name)
    assert model.score([kneser_ney.token_hashes("the of")], model.arrays())["score"][0] < 0


def test_probabilities_sum_to_one(spark):
    docs = docs_of(spark, [(None, prose(i, 60), "en", "s", None) for i in range(20)])
    model = kneser_ney.train(docs)
    arrays = model.arrays()
    words = sorted({w for i in range(20) for w in lower(prose(i, 60)).split()})
    one = lambda text: model.score([kneser_ney.token_hashes(text)[:-1]], arrays)["score"][0]
    for first in ("the", words[3], "unseen-word"):
        given = one(first)
        mass = sum(10 ** (one(f"{first} {w}") - given) for w in [*words, "other-unseen"])
        end = model.score([kneser_ney.token_hashes(first)], arrays)["score"][0]
        assert mass + 10 ** (end - given) == pytest.approx(1.0)
