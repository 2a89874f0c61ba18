"""Near copies: texts whose word shingles are alike, beside those whose SimHash fingerprints are close."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import broadcast_below, small_batches, spread_rows, stage
from flowlens.llm.components import connected_components
from flowlens.llm.simhash import RADIUS, SEED, components_of, fingerprint, keep_firsts, shingles

WIDTH = 5
SIMILARITY = 0.8
#: Two texts at 0.8 share one of 24 blocks of 6 minima with probability 0.9993, at 0.85 with 0.99999.
BLOCKS = 24
ROWS = 6
#: Different texts, and shingles of texts, that a task compares with each other at once.
CROWD = 512
TILE = 1 << 18
#: A group of texts that meet is compared as a whole up to so many tiles, by its blocks beyond.
MOST_TILES = 16
_CHUNK = 512


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text, A-Z in lower case."""
    digest = xxhash.xxh64_intdigest
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles(data, width)), dtype=np.uint64))


def _name_of(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def block_keys(hashes: np.ndarray, blocks: int = BLOCKS, rows: int = ROWS) -> list[int]:
    """One signed 64-bit key for each block of least values under ``rows`` seeded permutations."""
    draw = np.random.default_rng(SEED)
    odd = draw.integers(0, 1 << 63, size=blocks * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, size=blocks * rows, dtype=np.uint64)
    least = np.full(blocks * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), _CHUNK):
        mixed = hashes[start:start + _CHUNK, None] * odd + add
        mixed ^= mixed >> np.uint64(32)
        mixed *= odd
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * rows:(i + 1) * rows].tobytes(), i) for i in range(blocks)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def with_sketch(docs: DataFrame, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """The key columns, ``fp``, and ``set_id``, ``n`` and ``keys`` of the shingles (null without words)."""
    narrow = spread_rows(docs).select(*(c.alias(n) for n, c in keys.items()), F.col(text).alias("_body"))
    fields = narrow.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields),
                        "fp bigint, set_id bigint, n int, keys array<bigint>"])

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sets = [shingle_set(t) for t in texts]
            ids = [_name_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([fingerprint(t) for t in texts], pa.int64()), pa.array(ids, pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([block_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "fp", "set_id", "n", "keys"])

    return narrow.mapInArrow(run, schema)


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) of the texts that ``wanted`` (set_id, r) names by the hash of a document's id and text."""
    named = F.xxhash64("doc_id", F.xxhash64("text")).alias("r")
    texts = docs.select(named, F.col("text").alias("_body")).join(broadcast_below(wanted.select("r", "set_id"), 16), "r")

    def run(batches):
        for batch in small_batches(batches):
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            # another row of the same hash, if there ever is one, isn't the text that is wanted
            own = [len(s) and _name_of(s) == i for s, i in zip(sets, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["set_id", "shingles"]).filter(pa.array(own, pa.bool_()))

    found = stage(texts.select("_body", "set_id").mapInArrow(run, "set_id bigint, shingles array<bigint>"), "shingles")
    # only rows that are equal in id and text name a set twice; the arrays are moved for these alone
    return found if found.count() == wanted.count() else stage(found.dropDuplicates(["set_id"]), "shingles")


def spanning_links(sets: list[np.ndarray], group: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places of sets whose links join the given groups to those of all pairs that reach the similarity.

    ``group``: numbers from 0. A pair within the largest group needs no look, and every other pair has a set
    outside of it; such a set is compared with all, by counting the shingles it shares with each.
    """
    size, group = np.array([len(s) for s in sets], dtype=np.int64), group.copy()
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(flat, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(known)))])
    first = np.concatenate([[0], np.cumsum(size)])
    members, todo, links = np.bincount(group), np.ones(len(sets), dtype=bool), []
    while len(left := np.flatnonzero(todo & (group != members.argmax()))):
        i = int(left[0])
        todo[i] = False
        own = flat[first[i]:first[i + 1]]
        n = begin[own + 1] - begin[own]
        at = np.arange(n.sum()) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
        common = np.bincount(holders[at], minlength=len(sets))
        alike = np.flatnonzero((common / (size + size[i] - common) >= similarity) & (group != group[i]))
        for g, j in zip(*np.unique(group[alike], return_index=True)):
            links.append((i, int(alike[j])))
            members[group[i]] += members[g]
            members[g] = 0
            group[group == g] = group[i]
    return links


def _links_in_tiles(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of each tile; ``rows``: kind, place, i, j, which name it, set_id, and root, its group so far."""
    def run(tile: pa.Table) -> pa.Table:
        ids, at = np.unique(tile["set_id"].to_numpy(), return_index=True)
        flat = tile["shingles"].combine_chunks()
        edges, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        _, group = np.unique(tile["root"].to_numpy()[at], return_inverse=True)
        links = spanning_links([values[edges[k]:edges[k + 1]] for k in at], group, similarity)
        u, v = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"u": ids[u], "v": ids[v]})

    rows = stage(rows, "tiles")
    met = texts.join(broadcast_below(rows, 64), "set_id")
    return stage(met.groupBy("kind", "place", "i", "j").applyInArrow(run, "u bigint, v bigint"), "alike")


def _tiles_of(cut: DataFrame) -> DataFrame:
    """Rows for ``_links_in_tiles`` from ``cut`` (kind, place, set_id, part, root): the pairs of each place's roots.

    The sets of the place's largest root (main) needn't meet each other; the rest meets the rest and the main.
    """
    roots = cut.groupBy("kind", "place", "root").agg(F.sum("part").alias("parts"))
    about = roots.groupBy("kind", "place").agg(
        F.max(F.struct("parts", "root")).alias("main"), F.sum("parts").alias("all"), F.count("*").alias("n")).where("n > 1")
    about = stage(about.select("kind", "place", "all", F.col("main.root").alias("main"),
                               F.ceil("main.parts").cast("int").alias("mains"),
                               F.ceil(F.greatest(F.col("all") - F.col("main.parts"), F.lit(1e-9))).cast("int").alias("rests")),
                  "places")
    # what fits one tile shares it with others: a pair of two places that is alike is a link as well
    small = about.where("all <= 1").agg(F.sum("all")).first()[0] or 0.0
    buckets = F.lit(int(small) + 1)
    met = cut.join(about, ["kind", "place"])
    whole = met.where("all <= 1").select(F.lit(0).alias("kind"), F.pmod(F.xxhash64("kind", "place"), buckets).alias("place"),
                                         F.lit(0).alias("i"), F.lit(0).alias("j"), "set_id", "root").distinct()
    parts = F.when(F.col("root") == F.col("main"), F.col("mains")).otherwise(F.col("rests"))
    met = met.where("all > 1").withColumn("t", F.pmod(F.xxhash64("set_id"), parts).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    t, rests = F.col("t"), F.col("rests")
    tiles = F.when(F.col("root") == F.col("main"), F.transform(upto("rests"), lambda i: tile(i, rests + t))).otherwise(
        F.concat(F.transform(upto("rests"), lambda j: tile(F.least(t, j), F.greatest(t, j))),
                 F.transform(upto("mains"), lambda j: tile(t, rests + j))))
    cut_up = met.select("kind", "place", F.explode(tiles).alias("b"), "set_id", "root")
    return whole.union(cut_up.select("kind", "place", "b.i", "b.j", "set_id", "root"))


def similar_sets(docs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between sets of shingles, whose components are those of all that meet and reach the similarity.

    ``sets``: set_id, n, keys, r. Sets that share a block of minima meet, and all that hang together so are a
    group. A task compares a tile: at most some ``crowd`` sets or ``TILE`` shingles, in which all pairs are looked
    at, but for those that hang together already. Small groups share tiles. A larger group is dealt at random to
    tiles, twice, and linked within these, which is linear; then every two tiles of what doesn't hang together by
    then meet, so that no pair is left out. A group of more than ``MOST_TILES`` tiles is taken by its blocks
    there. So no group is in one task; the last step is quadratic in tiles of sets that meet and aren't alike.
    """
    dealt = sets.select("set_id", F.explode("keys").alias("key"))
    shared = stage(dealt.groupBy("key").agg(F.min("set_id").alias("u"), F.count("*").alias("m")).where("m > 1").drop("m"),
                   "shared-keys")
    met = stage(dealt.join(broadcast_below(shared, 24), "key"), "met")
    groups = stage(connected_components(met.select("u", F.col("set_id").alias("v"))).toDF("set_id", "place"), "groups")
    part = F.greatest(F.col("n") / F.lit(float(TILE)), F.lit(1.0 / crowd)).alias("part")
    wanted = stage(sets.join(broadcast_below(groups, 16), "set_id").select("set_id", "place", part, "r"), "wanted")
    texts = _shingles_of(docs, wanted)
    heavy = stage(wanted.groupBy("place").agg(F.sum("part").alias("parts")).where("parts > 1"), "heavy")
    own = wanted.select(F.lit(1).alias("kind"), "place", "set_id", "part", F.col("set_id").alias("root"))
    if heavy.isEmpty():
        return _links_in_tiles(_tiles_of(own), texts, similarity)
    crowded = stage(own.join(broadcast_below(heavy, 16), "place"), "crowded")
    random = [_links_in_tiles(crowded.select(
        "kind", "place", F.pmod(F.xxhash64(F.lit(salt), "set_id"), F.ceil("parts")).cast("int").alias("i"),
        F.lit(0).alias("j"), "set_id", "root"), texts, similarity) for salt in (1, 2)]
    links = reduce(DataFrame.union, random)
    roots = stage(connected_components(links).toDF("set_id", "found"), "joined")
    by_block = crowded.where(F.col("parts") > MOST_TILES).select("set_id", "part").join(met, "set_id")
    cut = (crowded.where(F.col("parts") <= MOST_TILES).drop("parts", "root")
           .select("kind", "place", "set_id", "part")
           .union(by_block.select(F.lit(2).alias("kind"), "key", "set_id", "part")))
    cut = cut.join(broadcast_below(roots, 16), "set_id", "left").select(
        "kind", "place", "set_id", "part", F.coalesce("found", "set_id").alias("root"))
    cut = stage(cut.union(own.join(broadcast_below(heavy, 16), "place", "left_anti").select(cut.columns)), "cut")
    return links.union(_links_in_tiles(_tiles_of(cut), texts, similarity))


def similar_prints(docs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between fingerprints of documents that are alike; ``prints``: of ``with_sketch``."""
    sets = stage(prints.where("set_id is not null").groupBy("set_id").agg(
        F.min("fp").alias("fp"), F.min(F.xxhash64("id", "h")).alias("r"), F.first("n").alias("n"),
        F.first("keys").alias("keys")), "sets")
    name = sets.select("set_id", F.col("fp").alias("_fp"))
    links = similar_sets(docs, sets, similarity, crowd)
    links = (links.join(name.toDF("u", "_u"), "u").join(name.toDF("v", "_v"), "v")
             .select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    # equal sets may differ in how often they repeat a shingle, and so in their fingerprints
    twins = prints.select("set_id", "fp").distinct().join(name, "set_id").select(F.col("_fp").alias("u"), F.col("fp").alias("v"))
    return stage(links.union(twins).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                 .distinct(), "similar")


def _prints(docs: DataFrame) -> DataFrame:
    keys = {"none": F.col("doc_id").isNull(), "id": F.col("doc_id"), "h": F.xxhash64("text")}
    return stage(with_sketch(docs, keys), "sketches")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id), one row per document: the least non-null doc_id of its group.

    Documents link if their fingerprints differ by at most ``radius`` bits, or their sets of 5-word shingles
    reach the similarity. ``docs`` needs doc_id and text; other columns are ignored. Texts without words are one
    group; a text of fewer than five words is one shingle. Repeated rows stay. An empty table gives no rows.
    """
    prints = _prints(docs)
    own = prints.groupBy("fp").agg(F.min("id").alias("least"))
    first = stage(components_of(own, "min(least)", radius, more=similar_prints(docs, prints, similarity, crowd)), "firsts")
    return prints.join(first, "fp").select(F.col("id").alias("doc_id"), F.col("first").alias("component_id"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Rows of ``docs`` with one document of each group of ``near_copies``: that of the least doc_id.

    Null ids come last; among rows that share the least id, the one of the least hash of the text stays, and of
    wholly equal rows one. All columns are kept as they are; needs doc_id and text.
    """
    prints = _prints(docs)
    return keep_firsts(docs, prints, radius, similar_prints(docs, prints, similarity, crowd))
