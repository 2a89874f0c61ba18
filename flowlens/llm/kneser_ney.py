"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays.

Words are known by their 64-bit hashes. Counting leaves two kinds of files in the folder that driver
and executors share: per shard of the hash range the sorted keys of word pairs with their counts, and
the sorted word hashes with what the model needs of a word, alone and as a context. Workers map the
files into memory and look keys up by binary search, so a model isn't bounded by a worker's memory.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import crc_of_id, shared_path, small_batches, spread_rows, stage, text_of

#: Text per shard of the hash range, and the most shards there are.
SHARD_BYTES = 8 << 20
MOST_SHARDS = 1 << 16
#: Tokens that a worker counts, and scores, at once, and pairs that it holds before it hands them on. These
#: fit workers of a few hundred MB; for a corpus of many TB, raise them with the workers' memory.
COUNT_TOKENS = 1 << 19
SCORE_TOKENS = 1 << 19
HELD_PAIRS = 3 << 19
#: Parts of a shard's hash range, as a power of two, that are summed one after the other.
PART_BITS = 4
#: Files that a worker keeps mapped.
OPEN_SHARDS = 4096
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: White space can't be in a word, so these are no words.
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" start", b" end"))
#: What the table of words holds for each: count, distinct words before it, and as a context the sum of
#: its pairs and how many of them are seen once, twice, more often.
FIELDS = ("count", "before", "total", "ones", "twos", "more")
#: What the parts of its sum hold, and of these what a shard of words tells the driver.
PARTS = ("count", "before", "total", "ones", "twos", "threes", "fours", "over")
SUMS = ("tokens", "types", "ones", "twos", "threes", "fours", "words", "after1", "after2", "after3", "after4", "after5")


def token_hashes(text: str | None) -> np.ndarray:
    """The words' hashes, A-Z lower-cased, and the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    key = first * _ONE + (second ^ (first >> np.uint64(31))) * _TWO
    key = (key ^ (key >> np.uint64(29))) * _ONE
    return key ^ (key >> np.uint64(32))


def _with_previous(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in a row, and the one before each in its text, the start for the first."""
    second = np.concatenate(tokens)
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]])] = START
    return first, second


def _gathered(batches, most: int):
    """Batches of texts with their tokens, joined until there are ``most`` tokens."""
    held, tokens, n = [], [], 0
    for batch in small_batches(batches, 64):
        held.append(batch)
        for text in batch.column(batch.num_columns - 1).to_pylist():
            tokens.append(token_hashes(text))
            n += len(tokens[-1])
        if n >= most:
            yield held, tokens
            held, tokens, n = [], [], 0
    if tokens:
        yield held, tokens


def local_path(path: str) -> str:
    """The path as workers open it. Memory mapping needs a mounted folder."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path} can't be mapped into memory: spark.checkpoint.dir must be a folder that is "
                         "mounted on driver and executors")
    return url.path if url.scheme else path


# ---------------------------------------------------------------- arrays

def _file(folder: str, shard: int) -> str:
    return f"{folder}/{shard >> 10:x}/{shard:x}"


def write_arrays(folder: str, shard: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
    """Write a shard under its one name. A task that runs again puts equal bytes in its place."""
    name = _file(folder, shard)
    os.makedirs(os.path.dirname(name), exist_ok=True)
    size = 4 if all(not len(v) or v.max() < 1 << 32 for v in values) else 8
    with open(own := f"{name}.{uuid.uuid4().hex}", "wb") as out:
        np.array([len(keys), size], dtype=np.uint64).tofile(out)
        np.ascontiguousarray(keys).tofile(out)
        for column in values:
            column.astype(f"u{size}").tofile(out)
    os.replace(own, name)


def written_shards(folder: str) -> dict[int, int]:
    """Number of keys of each shard that has a file, as seen from here."""
    out = {}
    for name in glob.glob(f"{glob.escape(folder)}/*/*"):
        if "." not in os.path.basename(name):
            with open(name, "rb") as file:
                out[int(os.path.basename(name), 16)] = int(np.fromfile(file, np.uint64, 1)[0])
    return out


class HashArrays:
    """Sorted key arrays with value columns, one memory-mapped file per shard of the hash range."""

    def __init__(self, folder: str, bits: int, columns: int, written: frozenset[int]):
        self.folder, self.bits, self.columns, self.open = folder, bits, columns, OrderedDict()
        #: Shards that have a file; the others hold no key.
        self.written = written

    def _shard(self, shard: int):
        if shard in self.open:
            self.open.move_to_end(shard)
            return self.open[shard]
        known, values = np.zeros(0, np.uint64), np.zeros((self.columns, 0))
        if shard in self.written:
            name = _file(self.folder, shard)
            if not os.path.exists(name):
                raise FileNotFoundError(f"{name} isn't seen here: spark.checkpoint.dir must be mounted on all workers")
            data = np.memmap(name, dtype=np.uint8, mode="r")
            n, size = (int(x) for x in data[:16].view(np.uint64))
            known = data[16:16 + 8 * n].view(np.uint64)
            values = data[16 + 8 * n:].view(np.dtype(f"u{size}")).reshape(self.columns, n)
        self.open[shard] = known, values
        if len(self.open) > OPEN_SHARDS:
            self.open.popitem(last=False)
        return known, values

    def find(self, keys: np.ndarray) -> np.ndarray:
        """(columns, keys) values of sorted, distinct keys; 0 where a key is unknown."""
        out = np.zeros((self.columns, len(keys)), dtype=np.float64)
        shards = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.diff(shards, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
        for low, high in zip(edges, [*edges[1:], len(keys)]):
            known, values = self._shard(int(shards[low]))
            if not len(known):
                continue
            at = np.searchsorted(known, keys[low:high])
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == keys[low:high])
            out[:, low + hit] = values[:, at[hit]]
        return out


@dataclass
class Model:
    """What workers get: where the arrays are, and a dozen numbers of the whole corpus."""
    folder: str
    bits: int
    pair_discounts: list
    word_discounts: list
    tokens: int
    vocabulary: int
    types: int
    word_rest: float
    pair_shards: frozenset[int] = frozenset()
    word_shards: frozenset[int] = frozenset()

    def arrays(self) -> tuple[HashArrays, HashArrays]:
        return (HashArrays(f"{self.folder}/pairs", self.bits, 1, self.pair_shards),
                HashArrays(f"{self.folder}/words", self.bits, len(FIELDS), self.word_shards))

    def score(self, tokens: list[np.ndarray], arrays) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score."""
        first, second = _with_previous(tokens)
        pairs, words = arrays
        # keys in order read every page of a mapped file once
        known, at = np.unique(np.append(second, START), return_inverse=True)
        word = words.find(known)
        own, before = word[:, at[:-1]], word[2:, np.where(first == START, at[-1], np.roll(at[:-1], 1))]
        keys, at = np.unique(pair_keys(first, second), return_inverse=True)
        count = pairs.find(keys)[0][at]
        uniform = 1.0 / (self.vocabulary + 1)
        p = _discounted(own[1], self.word_discounts) / max(self.types, 1) + self.word_rest * uniform
        total = before[0]
        seen = total > 0
        d = self.pair_discounts
        rest = (d[0] * before[1] + d[1] * before[2] + d[2] * before[3]) / np.where(seen, total, 1)
        p = np.where(seen, _discounted(count, d) / np.where(seen, total, 1) + rest * p, p)
        base = np.log10((own[0] + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]])
        return {"n_tokens": np.array([len(t) for t in tokens]),
                "n_known": np.add.reduceat((own[0] > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)}


def _discounted(counts: np.ndarray, d: list) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def discounts(n: list) -> list:
    """Chen and Goodman's discounts from how many are seen once to four times; plain ones if one is 0."""
    if min(n) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3)]


# ---------------------------------------------------------------- counting

def pack(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs as places in the list of their words, byte planes apart, compressed: some 7 bytes a pair."""
    order = np.argsort(first, kind="stable")
    words, at = np.unique(np.concatenate([first[order], second[order]]), return_inverse=True)
    one, two = np.split(at.astype(np.uint32), 2)
    size = 4 if n.max() < 1 << 32 else 8
    planes = [np.diff(words, prepend=np.uint64(0)), np.diff(one, prepend=np.uint32(0)), two, n[order].astype(f"u{size}")]
    body = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in planes)
    return np.array([len(words), len(n), size], dtype=np.uint64).tobytes() + zstandard.compress(body, 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n, size = (int(x) for x in np.frombuffer(blob, np.uint64, 3))
    body, at, planes = np.frombuffer(zstandard.decompress(blob[24:]), np.uint8), 0, []
    for length, width in ((m, 8), (n, 4), (n, 4), (n, size)):
        plane = body[at:at + length * width].reshape(width, length)
        planes.append(np.ascontiguousarray(plane.T).view(f"u{width}").reshape(-1))
        at += length * width
    words = np.cumsum(planes[0], dtype=np.uint64)
    return words[np.cumsum(planes[1], dtype=np.uint32)], words[planes[2]], planes[3].astype(np.int64)


def _per_shard(batches):
    """Rows of one shard after the other; they come sorted by shard, the first column."""
    held, at = [], None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(shards, prepend=shards[0] - 1)) if len(shards) else []
        for low, high in zip(edges, [*edges[1:], len(shards)]):
            if held and shards[low] != at:
                yield int(at), pa.Table.from_batches(held)
                held = []
            at = shards[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield int(at), pa.Table.from_batches(held)


def _merged(first: np.ndarray, second: np.ndarray, n: np.ndarray):
    _, at, group = np.unique(pair_keys(first, second), return_index=True, return_inverse=True)
    return first[at], second[at], np.bincount(group, n).astype(np.int64)


def _count_pairs(bits: int):
    def counted(batches):
        held, size = [], 0
        for _, tokens in _gathered(batches, COUNT_TOKENS):
            first, second = _with_previous(tokens)
            _, at, n = np.unique(pair_keys(first, second), return_index=True, return_counts=True)
            held.append((first[at], second[at], n))
            size += len(at)
            if size >= HELD_PAIRS:
                held = [_merged(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size >= HELD_PAIRS // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield _merged(*map(np.concatenate, zip(*held)))

    def run(batches):
        for first, second, n in counted(batches):
            shard = (pair_keys(first, second) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(n), np.int32)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
            for low, high in zip(edges, [*edges[1:], len(order)]):
                part = order[low:high]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard[part[0]]], pa.int32()), pa.array([pack(first[part], second[part], n[part])], pa.binary())],
                    names=["shard", "pairs"])

    return run


def _in_parts(blobs, bits: int):
    """Packed pairs of a shard, unpacked and dealt to the parts of its hash range: first, second and n of each."""
    parts = [[] for _ in range(1 << PART_BITS)]
    for blob in blobs:
        first, second, n = unpack(blob.as_py())
        part = (pair_keys(first, second) << np.uint64(bits) >> np.uint64(64 - PART_BITS)).astype(np.uint8)
        order = np.argsort(part, kind="stable")
        n = n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n
        for at, low, high in zip(*_runs(part[order])):
            own = order[low:high]
            parts[at].append((first[own], second[own], n[own]))
    while parts:
        if held := parts.pop(0):
            yield tuple(map(np.concatenate, zip(*held)))


def _runs(sorted_parts: np.ndarray):
    starts = np.flatnonzero(np.diff(sorted_parts.astype(np.int64), prepend=-1))
    return sorted_parts[starts], starts, [*starts[1:], len(sorted_parts)]


def _words_of(first: np.ndarray, second: np.ndarray, n: np.ndarray):
    """The words of distinct pairs, and what these add to each of ``PARTS``."""
    words, at = np.unique(np.concatenate([first, second]), return_inverse=True)
    one, two = np.split(at, 2)
    m = len(words)
    adds = [np.bincount(two, n, m), np.bincount(two, minlength=m), np.bincount(one, n, m)]
    adds += [np.bincount(one, k, m) for k in (n == 1, n == 2, n == 3, n == 4, n > 4)]
    return words, np.stack(adds).astype(np.int64)


def _write_pairs(folder: str, bits: int):
    """Sum and write each shard's pairs, part by part of its hash range; hand on what the shard adds to its words."""
    def run(batches):
        for shard, rows in _per_shard(batches):
            keys, counts, words, adds = [], [], [], []
            for part in _in_parts(rows.column(1), bits):
                first, second, n = _merged(*part)
                keys.append(pair_keys(first, second))
                counts.append(n)
                word, add = _words_of(first, second, n)
                words.append(word)
                adds.append(add)
            # the parts follow each other in the order of the keys
            write_arrays(folder, shard, np.concatenate(keys), [np.concatenate(counts)])
            word, at = np.unique(np.concatenate(words), return_inverse=True)
            adds = [np.bincount(at, np.concatenate([a[k] for a in adds]), len(word)).astype(np.int64) for k in range(len(PARTS))]
            for low in range(0, len(word), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[low:low + 50_000]) for x in (word.view(np.int64), *adds)], names=["word", *PARTS])
    return run


def _write_words(folder: str):
    """Write each shard's words; hand on its sums."""
    def run(batches):
        for shard, rows in _per_shard(batches):
            word = rows.column(1).to_numpy().view(np.uint64)
            order = np.argsort(word)
            count, before, total, ones, twos, threes, fours, over = (
                rows.column(k + 2).to_numpy()[order] for k in range(len(PARTS)))
            write_arrays(folder, shard, word[order], [count, before, total, ones, twos, threes + fours + over])
            sums = [count.sum(), before.sum(), ones.sum(), twos.sum(), threes.sum(), fours.sum(), (count > 0).sum(),
                    *((before == k).sum() for k in (1, 2, 3, 4)), (before > 4).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sums], names=list(SUMS))
    return run


def train(docs: DataFrame) -> Model:
    """Count a bigram model over all rows of ``docs``, which needs ``text``; null is an empty text.

    Workers merge the pairs of a task before anything moves; then one shuffle by the hash range, of
    packed pairs, brings equal ones together. The task that sums a shard writes its array and hands on
    what it adds to its words, so no pair is shuffled twice, and a frequent word or pair is no large
    group: it is one row per task. A second, smaller shuffle sums the words. Files have fixed names
    and contents, so a task that is run again for a lost executor leaves them as they were.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_SHARDS, max(1, total // SHARD_BYTES)).bit_length() - 1
    shards = 1 << bits
    folder = local_path(shared_path(spark, "bigrams"))
    pairs = (spread_rows(docs).select(text_of("text").alias("text")).mapInArrow(_count_pairs(bits), "shard int, pairs binary")
             .repartition(shards, "shard").sortWithinPartitions("shard"))
    parts = pairs.mapInArrow(_write_pairs(f"{folder}/pairs", bits), ", ".join(f"`{c}` bigint" for c in ("word", *PARTS)))
    # never a literal: rows grouped by one would be dealt by the word alone, and a shard written by several tasks
    shard = F.shiftrightunsigned(F.shiftrightunsigned("word", 63 - bits), 1).cast("int")
    words = (parts.select(shard.alias("shard"), "*").repartition(shards, "shard").groupBy("shard", "word")
             .agg(*(F.sum(c).alias(c) for c in PARTS)).sortWithinPartitions("shard"))
    sums = stage(words.mapInArrow(_write_words(f"{folder}/words"), ", ".join(f"{c} bigint" for c in SUMS)), "word-sums")
    of = {c: x or 0 for c, x in zip(SUMS, sums.agg(*(F.sum(c) for c in SUMS)).first())}
    pair_d = discounts([of[c] for c in ("ones", "twos", "threes", "fours")])
    after = [of[f"after{k}"] for k in range(1, 6)]
    word_d = discounts(after[:4])
    rest = (word_d[0] * after[0] + word_d[1] * after[1] + word_d[2] * sum(after[2:])) / of["types"] if of["types"] else 1.0
    found, lexicon = written_shards(f"{folder}/pairs"), written_shards(f"{folder}/words")
    if sum(found.values()) != of["types"] or len(lexicon) != sums.count():
        raise FileNotFoundError(f"{folder} lacks arrays that workers wrote: spark.checkpoint.dir must be a folder that is "
                                "mounted on driver and executors")
    return Model(folder, bits, pair_d, word_d, of["tokens"], of["words"], of["types"], rest, frozenset(found), frozenset(lexicon))


# ---------------------------------------------------------------- scoring

def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``held_out`` with n_tokens, n_known, train_tokens, base_score and score per row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    narrow = spread_rows(docs).select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 1).alias("held_out"),
                                      text_of("text").alias("text"))
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, "
              "n_known bigint, train_tokens bigint, base_score double, score double")

    def run(batches):
        known = shared.value
        arrays = known.arrays()
        for held, tokens in _gathered(batches, SCORE_TOKENS):
            out = known.score(tokens, arrays)
            out["train_tokens"] = np.full(len(tokens), known.tokens, dtype=np.int64)
            kept = pa.Table.from_batches(held).select(["doc_id", "held_out"])
            for name in ("n_tokens", "n_known", "train_tokens", "base_score", "score"):
                kept = kept.append_column(name, pa.array(out[name]))
            yield from kept.to_batches()

    return narrow.mapInArrow(run, schema)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod 5 isn't 1, and score all of them.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts are the end alone.
    A null id counts as the empty text and so is learnt from. Repeated rows count, and are scored,
    each. The score is the base-10 logarithm of the probability of the words and the end, the first
    word's context being the start; without any row to learn from both scores are 0. An empty table
    gives an empty result.
    """
    learnt = docs.where(crc_of_id(F.col("doc_id")) % 5 != 1)
    return score_texts(docs, train(learnt))
