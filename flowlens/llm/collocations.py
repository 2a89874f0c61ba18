"""Phrase mining over occurrence relations: merge-join neighbours, count groups, keep the frequent, extend.

The relation of length k holds, sorted by piece and position, every place where a frequent phrase of k words
stands. It is kept in chunks of whole documents, written once and read by the next step:

1. extend and count: occurrences are merge-joined with those one place further in their piece, which gives the
   candidates of k + 1 words; each chunk's distinct ones with their counts go, packed, to shards of the
   phrases' hash range, where equal ones are added up;
2. keep: a shard answers every chunk which of its candidates are frequent (a semi-join in which nothing is
   broadcast and no phrase is a large group: it is one entry per chunk), and their occurrences are written.

The frequent phrases with their counts are then an ordinary table, and scores, the choice of the cut, what is
held in longer phrases and the ranks are joins and aggregates over it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.common import broadcast_below, small_batches, spread_rows, stage, text_of

LEAST_COUNT = 100
LONGEST = 5
TOP = 2000
#: Words of a chunk, which a worker holds, and text of a shard, whose counts a worker holds. For a corpus of
#: many TB raise both with the workers' memory.
CHUNK_TOKENS = 1 << 20
SHARD_BYTES = 16 << 20
MOST_SHARDS = 1 << 14
#: Languages of a chunk.
MOST_LANGS = 1 << 14

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A byte that no UTF-8 text holds marks the ends of pieces.
_MARK = b"\xff"
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _MARK * 10 + b" ")

_LEVEL = ("chunk string, length int, positions binary, phrases binary, members binary, lexicon binary, langs binary, "
          "names array<string>, found array<struct<lang: string, phrase: string, words: int, n: bigint>>")
_SENT = "chunk string, shard int, start int, keys binary, counts binary"


# ---------------------------------------------------------------- packing

def _packed(values: np.ndarray) -> bytes:
    """As few bytes as the largest value needs, byte planes apart, compressed."""
    size = next(k for k in (1, 2, 4, 8) if not len(values) or k == 8 or int(values.max()) < 1 << 8 * k)
    values = np.ascontiguousarray(values.astype(f"<u{size}"))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), size).T)
    return f"<u{size} {len(values)}\n".encode() + zstandard.compress(planes.tobytes(), 3)


def _unpacked(blob: bytes) -> np.ndarray:
    head, body = blob.split(b"\n", 1)
    kind, n = head.split()
    kind, n = np.dtype(kind.decode()), int(n)
    raw = np.frombuffer(zstandard.decompress(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)


def pieces(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and a mark where a piece ends."""
    cut = text.encode("utf-8", "surrogatepass").lower().translate(_CUT)
    return cut.replace(_MARK, b" " + _MARK + b" ").split()  # of white space only spaces are left


def phrase_keys(members: np.ndarray, word_keys: np.ndarray) -> np.ndarray:
    """64-bit keys of phrases given as rows of word numbers."""
    key = np.zeros(len(members), np.uint64)
    for column in members.T:
        key = (key ^ word_keys[column]) * _MIX
        key ^= key >> np.uint64(29)
    return key


class Chunk:
    """Occurrences of phrases of one length in some documents.

    ``positions`` rise, with one left free between pieces; ``phrases`` are row numbers of ``members``, which
    holds the phrases as numbers of words in ``lexicon``; ``langs`` has each word's place in ``names``. A
    chunk of length 0 is that of the words as they stand, of which nothing is known yet.
    """

    def __init__(self, name, length, positions, phrases, members, lexicon: list[bytes], langs, names: list[str]):
        self.name, self.length, self.positions, self.phrases, self.members = name, length, positions, phrases, members
        self.lexicon, self.langs, self.names = lexicon, langs, names

    def row(self, found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "chunk": self.name, "length": self.length, "names": self.names, "found": found,
            "positions": _packed(np.diff(self.positions, prepend=0)), "phrases": _packed(self.phrases),
            "members": _packed(self.members.reshape(-1)), "lexicon": zstandard.compress(b" ".join(self.lexicon), 3),
            "langs": _packed(self.langs)}], schema=_SCHEMA)

    @staticmethod
    def of(row: dict) -> "Chunk":
        words = zstandard.decompress(row["lexicon"])
        whole = lambda name: _unpacked(row[name]).astype(np.int64)
        return Chunk(row["chunk"], row["length"], np.cumsum(whole("positions")), whole("phrases"),
                     whole("members").reshape(-1, max(row["length"], 1)), words.split(b" ") if words else [], whole("langs"), row["names"])

    def phrase(self, members) -> str:
        return b" ".join(self.lexicon[w] for w in members).decode("utf-8", "surrogatepass")

    def candidates(self) -> tuple["Chunk", np.ndarray]:
        """Occurrences one word longer, by a merge of neighbours, and the phrases' keys, in whose order phrases are."""
        if self.length == 0:
            positions, phrases, members = self.positions, self.phrases, self.members
        else:
            next_to = np.flatnonzero(np.diff(self.positions) == 1)
            positions = self.positions[next_to]
            pairs, phrases = np.unique(self.phrases[next_to] * len(self.members) + self.phrases[next_to + 1], return_inverse=True)
            first, second = np.divmod(pairs, max(len(self.members), 1))
            members = np.hstack([self.members[first], self.members[second][:, -1:]])
        seeds = [xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass")) for n in self.names]
        words = np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(self.lexicon, self.langs.tolist())),
                            np.uint64, len(self.lexicon))
        keys = phrase_keys(members, words)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Chunk(self.name, self.length + 1, positions, place[phrases], members[order], self.lexicon, self.langs, self.names), keys[order]

    def only(self, frequent: np.ndarray) -> "Chunk":
        """The occurrences of some phrases, which are numbered anew, the most frequent first."""
        kept = frequent[self.phrases]
        phrases = self.phrases[kept]
        count = np.bincount(phrases, minlength=len(self.members))
        order = np.argsort(-count, kind="stable")[:np.count_nonzero(count)]
        place = np.zeros(len(self.members), np.int64)
        place[order] = np.arange(len(order))
        own = self.members[order]
        used, members = np.unique(own, return_inverse=True)
        return Chunk(self.name, self.length, self.positions[kept], place[phrases], members.reshape(own.shape),
                     [self.lexicon[w] for w in used], self.langs[used], self.names)


_SCHEMA = pa.schema([
    ("chunk", pa.string()), ("length", pa.int32()), *((c, pa.binary()) for c in ("positions", "phrases", "members", "lexicon", "langs")),
    ("names", pa.list_(pa.string())),
    ("found", pa.list_(pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])))])


# ---------------------------------------------------------------- steps

def _words(chunk_tokens: int):
    """Documents to chunks of the words as they stand. Between pieces a position is left free."""
    def chunk(lexicons, texts):
        names = list(lexicons)
        first = np.cumsum([0, *(len(lexicons[n]) - 1 for n in names)])
        numbers, sizes = [], dict.fromkeys(names, 0)
        for lang, own in texts:
            word = own >= 0
            sizes[lang] += int(word.sum())
            numbers += [np.where(word, own + first[names.index(lang)], -1), np.array([-1])]
        flat = np.concatenate(numbers)
        at = np.flatnonzero(flat >= 0)
        out = Chunk(uuid.uuid4().hex, 0, at, flat[at], np.arange(first[-1])[:, None],
                    [w for n in names for w in list(lexicons[n])[1:]], np.repeat(np.arange(len(names)), np.diff(first)), names)
        out = out.only(np.ones(first[-1], bool))
        # a language's number of words is that of the phrase of none
        return out.row([{"lang": lang, "phrase": "", "words": 0, "n": n} for lang, n in sizes.items()])

    def run(batches):
        lexicons, texts, held = {}, [], 0
        for batch in small_batches(batches, 64):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = lexicons.setdefault(lang, {_MARK: -1})
                own = np.array([words.setdefault(w, len(words) - 1) for w in pieces(text)], np.int64)
                texts.append((lang, own))
                held += len(own) + 1
                if held >= chunk_tokens or len(lexicons) >= MOST_LANGS:
                    yield chunk(lexicons, texts)
                    lexicons, texts, held = {}, [], 0
        if texts:
            yield chunk(lexicons, texts)
    return run


def _chunks(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, *Chunk.of(row).candidates()


def _send(bits: int):
    """The candidates of each chunk, by shard, in the order of their keys."""
    def run(batches):
        for _, chunk, keys in _chunks(batches):
            counts = np.bincount(chunk.phrases, minlength=len(keys))
            shards = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            edges = np.flatnonzero(np.diff(shards, prepend=-1)) if len(keys) else []
            spans = list(zip(edges, [*edges[1:], len(keys)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk.name] * len(spans), pa.string()), pa.array([int(shards[a]) for a, _ in spans], pa.int32()),
                 pa.array([int(a) for a, _ in spans], pa.int32()),
                 pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                 pa.array([_packed(counts[a:b]) for a, b in spans], pa.binary())], names=["chunk", "shard", "start", "keys", "counts"])
    return run


def _count_shard(least: int):
    """Add up the counts of a shard and tell every chunk which of its candidates are frequent.

    The chunk that comes first with a frequent phrase also gets its count, so that one of them tells it.
    """
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        keys = [np.cumsum(_unpacked(b.as_py()), dtype=np.uint64) for b in rows["keys"]]
        counts = np.concatenate([_unpacked(b.as_py()) for b in rows["counts"]]).astype(np.int64)
        edges = np.cumsum([0, *map(len, keys)])
        _, owner, same = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.zeros(len(owner), np.int64)
        np.add.at(total, same, counts)
        own = np.zeros(len(same), bool)
        own[owner] = True
        total = total[same]
        out = []
        for chunk, start, low, high in zip(rows["chunk"].to_pylist(), rows["start"].to_pylist(), edges, edges[1:]):
            hit = total[low:high] >= least
            if hit.any():
                told = np.flatnonzero(hit & own[low:high])
                out.append((chunk, _packed(start + np.flatnonzero(hit)), _packed(start + told), _packed(total[low:high][told])))
        columns = list(zip(*out)) or [()] * 4
        return pa.table({"chunk": pa.array(columns[0], pa.string()), **{
            name: pa.array(c, pa.binary()) for name, c in zip(("hits", "told", "n"), columns[1:])}})
    return run


def _keep():
    """Chunks with their answers to the occurrences that stay, and the frequent phrases that a chunk has to tell."""
    def run(batches):
        for row, chunk, _ in _chunks(batches):
            frequent = np.zeros(len(chunk.members), bool)
            found = []
            for answer in row["answers"]:
                frequent[_unpacked(answer["hits"]).astype(np.int64)] = True
                found += [{"lang": chunk.names[chunk.langs[chunk.members[p, 0]]], "phrase": chunk.phrase(chunk.members[p]),
                           "words": chunk.length, "n": int(n)}
                          for p, n in zip(_unpacked(answer["told"]).tolist(), _unpacked(answer["n"]).tolist())]
            yield chunk.only(frequent).row(found)
    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST,
                     chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(lang, phrase, words, n): phrases of 1 to ``longest`` words that occur ``least`` times or more in a language.

    Rows of no words, one or more a language, add up to the words of the language. ``docs`` needs lang and
    text; other columns are ignored. A null lang is ``und``, a null text is empty.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_SHARDS, max(1, total // SHARD_BYTES)).bit_length() - 1
    narrow = spread_rows(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of("text").alias("text"))
    level = stage(narrow.mapInArrow(_words(chunk_tokens), _LEVEL), "occurrences")
    found = [level.select(F.explode("found").alias("f")).select("f.*")]
    for _ in range(longest):
        sent = level.drop("found").mapInArrow(_send(bits), _SENT)
        answers = sent.groupBy("shard").applyInArrow(_count_shard(least), "chunk string, hits binary, told binary, n binary")
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("hits", "told", "n")).alias("answers"))
        level = stage(level.drop("found").join(answers, "chunk").mapInArrow(_keep(), _LEVEL), "occurrences")
        found.append(level.select(F.explode("found").alias("f")).select("f.*"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return stage(out, "phrases")


def _cut(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def mine_collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP,
                      chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to ``longest`` words of each language.

    ``docs`` needs lang and text; other columns are ignored. A null lang is ``und``; null and empty texts have
    no words; repeated rows count each; an empty table gives an empty result. Ties in score go to the larger
    count, then to the phrase that comes first in the order of UTF-8 bytes. Phrases are cut where the score,
    1000 times the count over what independent parts would have, is least, and left out if a longer phrase
    holds all of their occurrences.
    """
    phrases = frequent_phrases(docs, least, longest, chunk_tokens)
    sizes = phrases.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    known = phrases.where("words > 0").select("lang", "phrase", F.col("n").alias("a"))
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _cut(F.col("w"), F.lit(1), F.col("k")).alias("left"),
                       _cut(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = lambda side, count: known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.join(broadcast_below(sizes, 64), "lang")
    # 38 digits hold the product of 1000 and two counts of a corpus of 10 ** 17 words
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"(1000BD * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = (cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
            .groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.first("a").alias("a"), F.first("n").alias("n")))
    # what stands in a longer phrase as often as by itself stands so in one that is one word longer, too
    longer = candidates.where("words > 2").select("lang", F.col("a").alias("more"), F.explode(F.array(
        _cut(F.col("w"), F.lit(1), F.col("words") - 1), _cut(F.col("w"), F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = best.join(longer, ["lang", "phrase"], "left").where("more is null or more < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
