"""Mixing sources to target weights by fitting word budgets as bounded subset sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.common import broadcast_below, spread_rows, stage, text_of

MOST_COPIES = 3
SEED = 17
#: Words that are left for the knapsack table; its arrays take some 12 bytes each.
KNAPSACK_WORDS = 1 << 16
#: Parts of the hash range by which a length's documents are cut.
PARTS = 4096


def word_count(text) -> F.Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


# ---------------------------------------------------------------- targets

def source_targets(totals: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes
    by weight; where one would pass three times its source's size it stops there and the excess goes
    to the others by weight, until none is above. Places in the order are counted within ranges of
    source names, so that a long list of sources isn't sorted in one task; each round of resharing
    is one aggregate, of which the driver sees four numbers.
    """
    spark = totals.sparkSession
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "source-ranges")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = stage(ranged.withColumn("place", place).join(F.broadcast(before), "part").select(
        "source", "source_size",
        ((F.coalesce("before", F.lit(0)) + F.col("place") - 1) % 3 + 1).cast("double").alias("weight"))
        .withColumn("most", F.lit(float(MOST_COPIES)) * F.col("source_size")), "source-weights")
    level, stopped = 0.0, -1
    while True:
        # a source is at its stop once the level of words a unit of weight reaches it
        at = (F.col("most") <= F.lit(level) * F.col("weight"))
        total, held, weight, count = ranked.agg(
            F.sum("source_size"), F.sum(F.when(at, F.col("most"))), F.sum(F.when(~at, F.col("weight"))),
            F.count(F.when(at, 1))).first()
        if not weight or count == stopped:
            break
        level, stopped = ((total or 0) - (held or 0.0)) / weight, count
    return ranked.select("source", "source_size", "weight",
                         F.least("most", F.lit(level) * F.col("weight")).alias("target"))


# ---------------------------------------------------------------- fitting

def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that the sum is the largest one not above ``budget``.

    Bounded knapsack as a table of reachable sums, with counts split in powers of two. For every sum
    the first part that reached it is kept, from which the choice is read back.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    budget = int(budget)
    if budget <= 0:
        return taken
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by_size = np.full(budget + 1, -1, dtype=np.int32)
    by_count = np.zeros(budget + 1, dtype=np.int64)
    for j in np.argsort(-sizes, kind="stable"):
        size = int(sizes[j])
        left = min(int(counts[j]), budget // size) if size > 0 else 0
        part = 1
        while left > 0 and not reached[budget]:
            part = min(part, left)
            step = part * size
            new = np.zeros_like(reached)
            new[step:] = reached[:-step]
            new &= ~reached
            by_size[new], by_count[new] = j, part
            reached |= new
            left -= part
            part *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        j, part = by_size[at], int(by_count[at])
        taken[j] += part
        at -= part * int(sizes[j])
    return taken


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: float,
               knapsack: int = KNAPSACK_WORDS) -> np.ndarray:
    """Documents of each length to take for about ``budget`` words.

    The bulk is taken in proportion to the counts, which keeps the mix of lengths. Then one more of a
    length, or as many as fit, by falling fraction, until at most ``knapsack`` words are left; these
    are fitted exactly. Zero lengths are taken in proportion.
    """
    total = float((sizes * counts).sum())
    share = min(1.0, budget / total) if total else 1.0
    taken = np.floor(counts * share + 1e-9).astype(np.int64)
    left = int(round(budget)) - int((sizes * taken).sum())
    order = np.lexsort((-sizes, -(counts * share - taken)))
    for j in order:
        if left <= knapsack:
            break
        size = int(sizes[j])
        if size and taken[j] < counts[j]:
            more = min(int(counts[j] - taken[j]), max(0, left - knapsack // 2) // size, 1)
            taken[j] += more
            left -= more * size
    for j in np.argsort(-sizes, kind="stable"):
        if left <= knapsack:
            break
        size = int(sizes[j])
        if size:
            more = min(int(counts[j] - taken[j]), left // size)
            taken[j] += more
            left -= more * size
    return taken + subset_sum(sizes, counts - taken, min(left, knapsack))


def _plan(lengths: pd.DataFrame) -> pd.DataFrame:
    """One source: whole copies of all documents, and how many of each length come once more."""
    lengths = lengths.sort_values("size")
    sizes, counts = lengths["size"].to_numpy(np.int64), lengths["n"].to_numpy(np.int64)
    target, total = float(lengths["target"].iloc[0]), int((sizes * counts).sum())
    copies = min(MOST_COPIES, int(target // total)) if total else 1
    if copies < MOST_COPIES and total:
        extra = fit_budget(sizes, counts, target - copies * total)
    else:
        extra = np.zeros(len(sizes), dtype=np.int64)
    return lengths.assign(copies=copies, extra=extra)[["source", "size", "source_size", "target", "copies", "extra"]]


# ---------------------------------------------------------------- the mix

def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source), one row per row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are ignored. Size is the number of words,
    0 for null. A source is taken in ``copies`` whole copies plus a seeded choice of documents, for
    which documents are counted by length, the words still wanted are fitted by a bounded knapsack,
    and of each length the documents of the least seeded hash are taken. No document exceeds three
    times its size. Hash ties go by doc_id; rows that agree in source, size and doc_id are alike, so
    it doesn't matter which of them is chosen. A null source is a source, the last one. An empty
    table gives an empty result.

    A length of a source is cut by hash into parts, and only the part in which the cut falls is ranked,
    so a length that holds a third of all rows is no large task. The only per-source task sees one
    row per distinct length.
    """
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = stage(spread_rows(docs).select("doc_id", "source", word_count("text").alias("size"),
                                           hashed.alias("h")), "sizes")
    part = F.shiftrightunsigned("h", 64 - (PARTS.bit_length() - 1)).cast("int").alias("part")
    sized = sized.select("*", part)
    parts = stage(sized.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "length-parts")
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stage(source_targets(totals), "targets").drop("weight")
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    small = broadcast_below(targets, 128)
    wanted = lengths.join(small, same(lengths, targets, "source")).drop(targets.source)
    plan = stage(wanted.groupBy("source").applyInPandas(
        _plan, "source string, size long, source_size long, target double, copies int, extra long"), "plan")
    run = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = (parts.join(plan, same(parts, plan, "source", "size")).drop(plan.source).drop(plan["size"])
           .withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
           .withColumn("wanted", F.col("extra") - F.col("before"))
           .select("source", "size", "part", "source_size", "target", "copies", "wanted",
                   (F.col("wanted") >= F.col("n")).alias("whole")))
    met = sized.join(cut, same(sized, cut, "source", "size", "part")).drop(cut.source).drop(cut["size"]).drop(cut.part)
    inside = (F.col("wanted") > 0) & ~F.col("whole")
    ranked = Window.partitionBy("source", "size", "part").orderBy("h", "doc_id")
    chosen = F.col("whole") | (F.col("rank") <= F.col("wanted"))
    settled = met.where(~inside).withColumn("more", F.col("whole").cast("int"))
    cutting = met.where(inside).withColumn("rank", F.row_number().over(ranked)).withColumn(
        "more", chosen.cast("int")).drop("rank")
    return settled.unionByName(cutting).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("copies") + F.col("more"))).cast("long").alias("taken"),
        (F.col("copies") + F.col("more")).alias("copies"), "source")
