"""SimHash fingerprints of whole texts and their near-duplicate groups by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import small_batches, spread_rows, stage
from flowlens.llm.components import connected_components

WIDTH = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
#: Above so many fingerprints in a block, links are found through common neighbours, not pairs.
CROWD = 48
_CHUNK = 1 << 15


def shingles(data: bytes, width: int) -> Iterator[bytes]:
    """Runs of ``width`` words joined by one space; a shorter text is one run, no words are none."""
    words = data.split()
    if not words:
        return iter(())
    if len(words) < width:
        return iter((b" ".join(words),))
    return map(b" ".join, zip(*(words[i:] for i in range(width))))


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes; 0 for none. Signed 64 bits."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[start:start + _CHUNK])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of a text: words of A-Z lower-cased, shingles with repeats, XXH64 with seed 42."""
    digest = xxhash.xxh64_intdigest
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return majority_bits(np.array([digest(s, SEED) for s in shingles(data, width)], dtype=np.uint64))


def with_fingerprint(docs: DataFrame, keys: dict[str, Column], text: str = "text",
                     width: int = WIDTH) -> DataFrame:
    """The named key columns and ``fp`` (long), one row per input row. No shuffle; batches are small."""
    narrow = spread_rows(docs).select(*(c.alias(n) for n, c in keys.items()), F.col(text).alias("_body"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]),
                        "fp bigint"])

    def run(batches):
        for batch in small_batches(batches):
            fps = [fingerprint(t, width) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())],
                                             names=[*batch.schema.names[:-1], "fp"])

    return narrow.mapInArrow(run, schema)


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of ``blocks - radius`` blocks each. Two fingerprints within the radius differ in at most
    ``radius`` blocks, so they agree under one of the masks at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(part) for part in combinations(whole, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
               crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` whose components are those of all links.

    Fingerprints are dealt by each mask. In a block of at most ``crowd`` of them every pair is
    compared. In a larger one, each fingerprint names itself and its neighbours at one bit outside
    the mask; two within distance two share such a name, and all who share one are within two, so a
    star to the least is enough. At radius 1 a name ties those who name it to the fingerprint that it is,
    if there is one. Thus rows stay linear in the fingerprints and none is left out. Radius is 0, 1 or 2
    for this reason; at 0 distinct fingerprints have no links.
    """
    if not 0 <= radius <= 2 or blocks <= radius:
        raise ValueError("radius must be 0, 1 or 2, and there must be more blocks than that")
    masks = block_masks(blocks, radius)
    fp = F.col("fp")
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)))
    dealt = stage(prints.select("fp").distinct().select("fp", F.explode(keys).alias("b"))
                  .select("fp", "b.mask", "b.key"), "blocks")
    met = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.join(met, ["mask", "key"])
    differ = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    pairs = F.flatten(F.transform("fs", lambda a: F.transform(
        F.filter("fs", lambda b: (b > a) & (differ(a, b) <= radius)),
        lambda b: F.struct(a.alias("u"), b.alias("v")))))
    few = (met.where(F.col("n") <= crowd).groupBy("mask", "key").agg(F.collect_list("fp").alias("fs"))
           .select(F.explode(pairs).alias("l")).select("l.u", "l.v"))
    flips = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(masks):
        free = [_signed(1 << b) for b in range(64) if not m >> b & 1]
        flips = F.when(F.col("mask") == i, F.array(F.lit(0).cast("bigint"),
                                                   *(F.lit(f).cast("bigint") for f in free))).otherwise(flips)
    names = (met.where(F.col("n") > crowd).select("fp", "mask", F.explode(flips).alias("flip"))
             .select("fp", "mask", fp.bitwiseXOR(F.col("flip")).alias("name")))
    if radius < 2:
        present = met.where(F.col("n") > crowd).select("mask", F.col("fp").alias("name"))
        many = (names.join(present, ["mask", "name"]).where((F.col("fp") != F.col("name")) & F.lit(radius == 1))
                .select(F.least("fp", "name").alias("u"), F.greatest("fp", "name").alias("v")))
        return few.union(many).distinct()
    least = names.groupBy("mask", "name").agg(F.min("fp").alias("u"), F.max("fp").alias("w")).where("u < w")
    many = names.join(least, ["mask", "name"]).where("fp > u").select("u", F.col("fp").alias("v"))
    return few.union(many).distinct()


def components_of(prints: DataFrame, order: str = "min(doc_id)", radius: int = RADIUS,
                  crowd: int = CROWD, more: DataFrame | None = None) -> DataFrame:
    """(fp, first) per distinct fingerprint: ``order``, an aggregate, over its whole component.

    ``more`` are further links (u, v) between fingerprints.
    """
    own = stage(prints.groupBy("fp").agg(F.expr(order).alias("own")), "prints")
    links = near_links(own, radius, crowd=crowd)
    roots = stage(connected_components(links if more is None else links.union(more)), "roots")
    linked = own.join(roots.withColumnRenamed("node", "fp"), "fp")
    firsts = linked.groupBy("root").agg(F.min("own").alias("first"))
    linked = linked.join(firsts, "root").select("fp", "first")
    return (own.join(linked, "fp", "left")
            .select("fp", F.coalesce("first", "own").alias("first")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH,
                    crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts have
    fingerprint zero and link like any other. component_id is the least non-null doc_id reachable
    through links of at most ``radius`` bits, null if the component has none. Repeated rows stay.
    """
    prints = stage(with_fingerprint(docs, {"doc_id": F.col("doc_id")}, width=width), "fingerprints")
    # staged, so that the join deals both sides anew and may split a fingerprint of very many copies
    first = stage(components_of(prints, radius=radius, crowd=crowd), "firsts").withColumnRenamed("first", "component_id")
    return prints.join(first, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` with one document of each near-duplicate group: that of the least doc_id.

    Null ids come last; among rows that share the least id, the one of the least hash of (id, text)
    stays, and of wholly equal rows one. All columns are kept as they are; needs doc_id and text.
    """
    tie = F.xxhash64("text")
    keys = {"none": F.col("doc_id").isNull(), "id": F.col("doc_id"), "h": tie}
    prints = stage(with_fingerprint(docs, keys, width=width), "fingerprints")
    return keep_firsts(docs, prints, radius)


def keep_firsts(docs: DataFrame, prints: DataFrame, radius: int = RADIUS, more: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` that are the first of their group; ``prints``: fp, none, id and h per row."""
    own = prints.groupBy("fp", "none", "id", "h").agg(F.count("*").alias("n"))
    own = own.groupBy("fp").agg(F.min(F.struct("none", "id", "h")).alias("r"))
    firsts = components_of(own, "min(r)", radius, more=more).select("first").distinct()
    copies = (prints.select(F.struct("none", "id", "h").alias("first")).groupBy("first")
              .agg(F.count("*").alias("n")))
    stay = stage(firsts.join(copies, "first"), "stay").select(F.col("first").alias("__r"), F.col("n").alias("__n"))
    # columns go by place, so that none of their names clashes or needs quoting
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    doc_id, text = (plain[f"c{docs.columns.index(c)}"] for c in ("doc_id", "text"))
    # a rank is never null itself, so null ids meet by its fields
    same = (doc_id.isNull() == F.col("__r.none")) & doc_id.eqNullSafe(F.col("__r.id")) & (F.xxhash64(text) == F.col("__r.h"))
    single = plain.join(stay.where("__n = 1"), same, "left_semi")
    if stay.where("__n > 1").limit(1).count():
        twins = plain.join(stay.where("__n > 1"), same, "left_semi")
        single = single.union(twins.dropDuplicates([f"c{docs.columns.index(c)}" for c in ("doc_id", "text")]))
    return single.toDF(*docs.columns)
