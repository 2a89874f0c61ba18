"""Hard negatives by Kronecker-packed products: exact integer scores of whole blocks of candidates at once.

The components of a block's candidates, made non-negative by a bias, lie side by side in the fields of one
wide integer per dimension. That integer times one component of an anchor holds the products of all
candidates; summed over the dimensions, its fields are their biased inner products. Fields are as wide as
the largest sum needs, so nothing carries over and the scores that are unpacked are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.common import broadcast_hint, spread_rows, stage

SCALE = 256
ANCHOR_STEP = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between this percentage of the positive's and the positive's.
LEAST_PERCENT = 80
#: Candidates of a block and anchors of a group: what a task holds, whatever the tables' size.
BLOCK_ROWS, GROUP_ROWS = 2048, 128
#: Groups of anchors whose best candidates a task keeps before it hands them on.
HELD_GROUPS = 64


# ---------------------------------------------------------------- packing

def _whole(values: list[int]) -> bytes:
    """Integers of any size as one blob."""
    return " ".join(map(str, values)).encode()


def _numbers(blob: bytes) -> list[int]:
    return [int(x) for x in blob.split()]


def scaled(vector) -> list[int]:
    """floor(256 x) of each component, as exact integers."""
    return [int(x) for x in np.floor(SCALE * np.asarray(vector, dtype=np.float64)).tolist()]


@dataclass
class Packed:
    """A block of candidates: per dimension one integer whose fields are the biased components."""
    planes: list[int]
    field: int
    bias: int
    #: Unbiased components of each candidate, added up; Python's integers where 64 bits don't hold them.
    sums: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.sums)


def pack(vectors: list[list[int]], anchor_most: int) -> Packed:
    """Candidates packed for anchors whose biased components are at most ``anchor_most``.

    Vectors of fewer dimensions than the longest count as zero there.
    """
    size = max((len(v) for v in vectors), default=0)
    low = min((min(v, default=0) for v in vectors), default=0)
    bias = max(0, -low)
    most = bias + max((max(v, default=0) for v in vectors), default=0)
    bits = (size * most * anchor_most).bit_length()
    field = 4 if bits <= 32 else 8 if bits <= 64 else 8 * -(-bits // 64)
    planes = []
    for j in range(size):
        own = [v[j] + bias if j < len(v) else bias for v in vectors]
        raw = (np.array(own, dtype=f"<u{field}").tobytes() if field <= 8 and most < 1 << 63 else
               b"".join(x.to_bytes(field, "little") for x in own))
        planes.append(int.from_bytes(raw, "little"))
    return Packed(planes, field, bias, np.array([sum(v) for v in vectors]))


def products(block: Packed, anchor: list[int], anchor_bias: int) -> np.ndarray:
    """Exact inner products of an anchor with every candidate of the block."""
    size = len(block.planes)
    own = [anchor[j] if j < len(anchor) else 0 for j in range(size)]
    total = 0
    for x, plane in zip(own, block.planes):
        total += plane * (x + anchor_bias)
    raw = total.to_bytes(block.field * block.rows, "little")
    # (a + A)(x + B) = a x + a B + A x + A B, summed over the dimensions
    fixed = block.bias * sum(own) + size * anchor_bias * block.bias
    if block.field == 4 and block.sums.dtype != object:  # a sum of biased products holds each of these terms
        return np.frombuffer(raw, dtype="<u4").astype(np.int64) - fixed - anchor_bias * block.sums
    fields = [int.from_bytes(raw[i:i + block.field], "little") for i in range(0, len(raw), block.field)]
    return np.array([f - fixed - anchor_bias * s for f, s in zip(fields, block.sums.tolist())], dtype=object)


def first_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best of the allowed: higher scores first, ties by smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > n:
        kept = scores[at]
        least = np.partition(kept, len(kept) - n)[len(kept) - n]
        at = at[kept >= least]
    if scores.dtype == object:
        return at[sorted(range(len(at)), key=lambda i: (-scores[at[i]], int(ids[at[i]])))[:n]]
    return at[np.lexsort((ids[at], -scores[at]))[:n]]


# ---------------------------------------------------------------- rows

def _plain(vectors: DataFrame) -> DataFrame:
    """vec_id, relabelled label and vector of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.cast("int").alias("label"),
                          v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)


def _blocks(anchor_most: int, block_rows: int):
    """Rows to blocks, each packed once; a block's number tells task and place, so that rows are told apart."""
    def packed(ids, labels, vectors):
        block = pack(vectors, anchor_most)
        return pa.RecordBatch.from_pydict({
            "ids": [np.array(ids, np.int64).tobytes()], "labels": [np.array(labels, np.int32).tobytes()],
            "sums": [_whole(block.sums.tolist())], "bias": [str(block.bias)], "field": pa.array([block.field], pa.int32()),
            "planes": pa.array([[p.to_bytes(block.field * len(ids), "little") for p in block.planes]], pa.list_(pa.binary()))})

    def run(batches):
        ids, labels, vectors = [], [], []
        for batch in batches:
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i), labels.append(label), vectors.append(scaled(v))
                if len(ids) == block_rows:
                    yield packed(ids, labels, vectors)
                    ids, labels, vectors = [], [], []
        if ids:
            yield packed(ids, labels, vectors)
    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, Packed]:
    return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32),
            Packed([int.from_bytes(p, "little") for p in row["planes"]], row["field"], int(row["bias"]),
                   np.array(_numbers(row["sums"]))))


def _best_per_task(anchor_bias: int, pick, n: int, schema: list[str]):
    """The best candidates of each anchor over all blocks that a task meets.

    ``pick(anchor, ids, labels, scores)`` gives (slot, places). A slot of an anchor keeps its ``n`` best.
    """
    def handed_on(best):
        rows = [(a, slot, int(i), int(s)) for (a, slot), (scores, ids) in best.items() for s, i in zip(scores, ids)]
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                           pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=schema)

    def run(batches):
        best, held, opened = {}, set(), (None, None)
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                if opened[0] != row["no"]:
                    opened = row["no"], _opened(row)
                ids, labels, block = opened[1]
                if row["group"] not in held and len(held) >= HELD_GROUPS:
                    yield handed_on(best)
                    best, held = {}, set()
                held.add(row["group"])
                for anchor in row["anchors"]:
                    scores = products(block, scaled(anchor["v"]), anchor_bias)
                    for slot, at in pick(anchor, ids, labels, scores):
                        if len(at):
                            key = anchor["anchor"], slot
                            s, i = scores[at], ids[at]
                            if key in best:
                                s, i = np.append(best[key][0], s), np.append(best[key][1], i)
                                order = first_of(s, i, np.ones(len(s), bool), n)
                                s, i = s[order], i[order]
                            best[key] = s, i
        if best:
            yield handed_on(best)
    return run


def _positives(anchor, ids, labels, scores):
    yield 0, first_of(scores, ids, (labels == anchor["label"]) & (ids != anchor["anchor_id"]), POSITIVES)


def _negatives(anchor, ids, labels, scores):
    other = labels != anchor["label"]
    for slot, bound in enumerate(anchor["bounds"]):
        # Python's integers: the products don't pass 64 bits unseen
        least = -(-LEAST_PERCENT * bound // 100)
        yield slot + 1, first_of(scores, ids, other & (scores <= bound) & (scores >= least), NEGATIVES)


def mine_hard_negatives(vectors: DataFrame, anchor_step: int = ANCHOR_STEP, block_rows: int = BLOCK_ROWS,
                        group_rows: int = GROUP_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` needs vec_id, embedding and label; other columns are ignored. Rows with a null in one of
    them, or with a null or non-finite component, take no part. Anchors are the rows whose vec_id
    ``anchor_step`` divides; they are met with all rows, block by block. An anchor's positives are the five
    best rows of its label with another vec_id; of the rows of other labels that score between 80 % of a
    positive and the positive, the five best are its hard negatives. Ties go to the smaller vec_id. Vectors
    may differ in length: missing components count as zero. Each copy of a repeated row is a candidate,
    and an anchor, of its own. An empty table, or one without anchors, gives an empty result. Scores must
    fit 64 bits; components may be of any size that allows it.

    Blocks are packed once and read twice: for positives, then for negatives under their scores. A task
    keeps the best of each anchor that it meets, so what is shuffled is a few rows per anchor and task.
    """
    rows = stage(_plain(spread_rows(vectors.select("vec_id", "embedding", "label"))), "vectors")
    spread = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # one bias for all anchors, from the largest component; doubles are exact there up to the one of rounding
    top = rows.where(F.col("vec_id") % anchor_step == 0).agg(F.max(spread)).first()[0] or 0.0
    bias = int(np.floor(SCALE * top)) + 1
    blocks = rows.mapInArrow(_blocks(2 * bias, block_rows),
                             "ids binary, labels binary, sums binary, bias string, field int, planes array<binary>")
    blocks = stage(blocks.withColumn("no", F.monotonically_increasing_id()), "blocks")
    anchors = stage(rows.where(F.col("vec_id") % anchor_step == 0).select(
        F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    total = anchors.count()
    n_groups = max(1, -(-total // group_rows))
    group = F.pmod(F.xxhash64("anchor"), F.lit(n_groups)).alias("group")
    schema = ["anchor", "slot", "other_id", "score"]
    kinds = "anchor bigint, slot int, other_id bigint, score bigint"

    def met(extra: DataFrame, pick, n: int) -> DataFrame:
        """Every block with every group of anchors: the stated queries against all rows."""
        held = stage(extra.groupBy(group).agg(F.collect_list(F.struct(*extra.columns)).alias("anchors")), "groups")
        # group numbers stand for the groups until a block's task is known, so that only blocks' own rows move
        pairs = blocks.select("no", F.explode(F.expr(f"sequence(0L, {n_groups - 1}L)")).alias("group"))
        pairs = broadcast_hint(anchors, 2048)(held).join(pairs, "group").join(blocks, "no")
        best = pairs.mapInArrow(_best_per_task(bias, pick, n, schema), kinds)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other_id")
        return stage(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n), "best")

    positives = met(anchors, _positives, POSITIVES).select(
        "anchor", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("place").alias("slot"))
    bounds = positives.groupBy("anchor").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p["positive_score"]).alias("bounds"))
    negatives = met(anchors.join(bounds, "anchor"), _negatives, NEGATIVES).select(
        "anchor", "slot", F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return negatives.join(positives, ["anchor", "slot"]).join(anchors.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
