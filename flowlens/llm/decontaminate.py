"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification."""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlens.llm.common import small_batches, spread_rows, text_of

WIDTH = 5
SIMILARITY = 0.8
#: Bits by which the fingerprints of similar windows may differ: at similarity 0.8 some 10 are
#: expected with a deviation of 3.
RADIUS = 20
#: Items that workers hold at once; a larger benchmark is searched in several passes.
ITEM_BLOCK_BYTES = 8 << 20
#: Words of a text whose bit counts are held at once.
PIECE = 1 << 14

_PUNCTUATION = string.punctuation.encode()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63], dtype=np.uint64)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation; a word of nothing else is none."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * _ODD[0] + words[k:k + n] * _ODD[k % len(_ODD)]
    return h ^ (h >> np.uint64(32))


def _majority(ones: np.ndarray, n: int) -> np.ndarray:
    bits = (2 * ones > n).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of shingle counts: sum of the lesser over sum of the greater counts."""
    least = sum(min(n, b[s]) for s, n in a.items())
    most = sum(a.values()) + sum(b.values()) - least
    return least / most if most else 0.0


def _shingles(words: list[bytes], width: int) -> Counter:
    return Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


@dataclass
class SizeIndex:
    """Items of one number of words, their fingerprints and the block index over these."""
    length: int
    width: int
    need: int
    ids: list = field(default_factory=list)
    words: list = field(default_factory=list)
    prints: np.ndarray | None = None
    blocks: list = field(default_factory=list)

    def close(self, radius: int) -> None:
        hashes = [shingle_hashes(word_hashes(w), self.width) for w in self.words]
        self.prints = np.concatenate([_majority(_bits(h).sum(axis=0, dtype=np.int64)[None, :], len(h)) for h in hashes])
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        for a, b in zip(edges, edges[1:]):
            value = (self.prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(value, kind="stable")
            self.blocks.append((a, b, order, value[order]))

    def within(self, prints: np.ndarray, radius: int):
        """(window, item) of all fingerprints within the radius.

        With one block more than bits that may differ, some block of a close pair is equal, so the
        union over the blocks misses none.
        """
        close = np.zeros((len(prints), len(self.prints)), dtype=bool)
        for a, b, order, value in self.blocks:
            own = (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            first, last = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
            n = last - first
            window = np.repeat(np.arange(len(prints)), n)
            place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            close[window, order[place]] = True
        windows, items = np.nonzero(close)
        apart = np.bitwise_count(prints[windows] ^ self.prints[items])
        keep = apart <= radius
        return windows[keep], items[keep], apart[keep]


class BenchmarkIndex:
    """Items by number of words, and the set of their shingles."""

    def __init__(self, items: list[tuple], width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius, self.sizes = similarity, radius, {}
        known: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            n = len(words)
            k = min(width, n)
            # two bags of m shingles of that similarity share at least so many
            need = max(1, math.ceil((n - k + 1) * 2 * similarity / (1 + similarity) - 1e-9))
            size = self.sizes.setdefault(n, SizeIndex(n, k, need))
            size.ids.append(item_id)
            size.words.append(words)
            known.setdefault(k, []).append(shingle_hashes(word_hashes(words), k))
        for size in self.sizes.values():
            size.close(radius)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.maps = {}
        for k, v in self.known.items():
            mask = (1 << max(16, int(len(v)).bit_length() + 4)) - 1
            self.maps[k] = (np.uint64(mask), np.zeros(mask + 1, dtype=bool))
            self.maps[k][1][(v & np.uint64(mask)).astype(np.int64)] = True

    def _anchors(self, hashes: np.ndarray, k: int) -> np.ndarray:
        mask, seen = self.maps[k]
        found = seen[(hashes & mask).astype(np.int64)]
        at = np.flatnonzero(found)
        if len(at):
            known = self.known[k]
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            found[at] = known[place] == hashes[at]
        return found

    def search(self, text: str | None) -> dict:
        """{item: (similarity, start word, words, differing bits)}: the best, first window of each item.

        A window that reaches the similarity shares at least ``need`` shingles with its item, so only
        windows with so many benchmark shingles are fingerprinted; this leaves out none. A text of fewer
        words than the item is one window, which must share the similarity's part of the item's shingles.
        """
        words = plain_words(text)
        best: dict = {}
        if not words or not self.sizes:
            return best
        hashes = word_hashes(words)
        for k, known in self.known.items():
            shingles = shingle_hashes(hashes, k)
            anchors = self._anchors(shingles, k)
            if not anchors.any():
                continue
            count = np.concatenate([[0], np.cumsum(anchors)])
            for size in self.sizes.values():
                m = size.length - size.width + 1
                if size.width != k:
                    continue
                if len(shingles) < m:
                    if count[-1] >= math.ceil(self.similarity * m - 1e-9):
                        self._piece(np.zeros(1, dtype=np.int64), shingles, words, size, len(shingles), best)
                    continue
                starts = np.flatnonzero(count[m:] - count[:-m] >= size.need)
                for lo in range(0, len(starts), PIECE):
                    self._piece(starts[lo:lo + PIECE], shingles, words, size, m, best)
        return best

    def _piece(self, starts, shingles, words, size, m, best) -> None:
        prints = np.empty(len(starts), dtype=np.uint64)
        done = 0
        while done < len(starts):
            low = int(starts[done])
            upto = int(np.searchsorted(starts, low + PIECE))
            part = starts[done:upto] - low
            sums = np.zeros((int(part[-1]) + m + 1, 64), dtype=np.int32)
            np.cumsum(_bits(shingles[low:low + len(sums) - 1]), axis=0, out=sums[1:])
            prints[done:upto] = _majority(sums[part + m] - sums[part], m)
            done = upto
        for w, i, apart in zip(*size.within(prints, self.radius)):
            start = int(starts[w])
            own = _shingles(words[start:start + size.length], size.width)
            same = weighted_similarity(own, _shingles(size.words[i], size.width))
            if same >= self.similarity - 1e-12:
                key, was = size.ids[i], best.get(size.ids[i])
                if was is None or same > was[0] or same == was[0] and start < was[1]:
                    best[key] = (same, start, min(size.length, len(words) - start), int(apart))


def item_blocks(items: DataFrame, limit: int = ITEM_BLOCK_BYTES) -> list[list[tuple]]:
    """(item_id, text) in lists of about ``limit`` bytes, each read by a job of its own when asked for."""
    items = items.select("item_id", text_of("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // limit) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in items.where(block == b).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
               width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, bits_apart) of every document and item that match.

    An item matches if a window of as many words as it has reaches the weighted-shingle similarity:
    ``width`` words to a shingle, or all of a shorter item; weights are the shingles' counts. A text of
    fewer words than the item is compared as a whole. The best window is told, the first of equals.
    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. Null or empty
    texts match nothing and items without a word are left out. Each copy of a repeated row has its own
    results; repeated item ids are told once, the better.
    Documents are never shuffled: items go to the workers in blocks of ``ITEM_BLOCK_BYTES``.
    """
    narrow = spread_rows(docs).select("doc_id", "text")
    id_type = items.schema["item_id"].dataType.simpleString()
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {id_type}, similarity double, "
              "start_word int, n_words int, bits_apart int")
    kind = to_arrow_type(items.schema["item_id"].dataType)
    found = None
    for block in item_blocks(items):
        part = narrow.mapInArrow(_searcher(docs.sparkSession, block, similarity, radius, width, kind), schema)
        found = part if found is None else found.union(part)
    return found


def _searcher(spark, block, similarity, radius, width, kind):
    """Matches with item ids of Arrow type ``kind``; without one, the rows that match nothing."""
    shared = spark.sparkContext.broadcast(block)

    def run(batches):
        index = BenchmarkIndex(shared.value, width, similarity, radius)
        for batch in small_batches(batches):
            if kind is None:
                clean = [not index.search(t) for t in batch.column("__text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))
                continue
            rows = [(i, item, *hit) for i, t in enumerate(batch.column(1).to_pylist())
                    for item, hit in index.search(t).items()]
            at, item, same, start, n, apart = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, kind),
                 pa.array(same, pa.float64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                 pa.array(apart, pa.int32())],
                names=["doc_id", "item_id", "similarity", "start_word", "n_words", "bits_apart"])

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
               width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` in which no item is found (see ``find_leaks``), with all their columns.

    Columns go by place meanwhile, so that none of their names clashes or needs quoting.
    """
    kept = docs.toDF(*("__text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    for block in item_blocks(items):
        kept = kept.mapInArrow(_searcher(docs.sparkSession, block, similarity, radius, width, None), kept.schema)
    return kept.toDF(*docs.columns)
