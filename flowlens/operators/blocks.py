"""Queries met with a catalogue of any size, block by block; no pair of a query and a document is kept.

Documents lie in blocks of hashed terms with their counts and of latent vectors. A batch of queries and a
block give two small dense matrices, of BM25 and of cosines, of which only each query's least, largest and
best cells go on. A catalogue whose blocks are proven small travels to the queries, which then don't move at
all; a larger one stays where it is and groups of queries come to its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.text import whitespace_tokens
from flowlens.operators.latent import LatentModel, arrays_of, fit_latent, gram_hashes, list_array, slices_of
from flowlens.session import BROADCAST_BYTES, broadcast_if_small, is_small, spread, stage

#: Documents and term entries of a block, and queries of a group.
DOC_ROWS, DOC_TERMS, QUERY_ROWS = 1024, 1 << 17, 256
#: Blocks of a file: some 2 MB each, and a task holds those of a file at once.
FILE_BLOCKS = 8
#: Entries of postings that are scored at once.
SCORED_ENTRIES = 1 << 20
#: A term with more than this share of all entries is joined by broadcast.
HOT_TERM_SHARE = 1 / 1024


def term_hashes(text: Column) -> Column:
    return F.transform(whitespace_tokens(text), lambda t: F.xxhash64(t))


@dataclass
class DocBlock:
    """Postings by term, and unit vectors, of some documents, by rising id."""
    ids: np.ndarray
    terms: np.ndarray
    places: np.ndarray
    tf: np.ndarray
    dl: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(row: dict) -> "DocBlock":
        """From the arrays of a row of blocks."""
        order = np.argsort(row["postings"], kind="stable")
        return DocBlock(row["ids"], row["postings"][order], row["places"][order], row["tf"][order], row["dl"],
                        row["vectors"].reshape(len(row["ids"]), -1))

    def bm25(self, starts, terms, weights, avg: float, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> np.ndarray:
        """Scores of queries given as term hashes and weights (count times idf), one after the other.

        Queries are taken together as long as they meet at most ``SCORED_ENTRIES`` postings, one at least.
        """
        part = self.tf * (k1 + 1.0) / (self.tf + k1 * (1.0 - b + b * self.dl[self.places] / (avg or 1.0)))
        first, last = (np.searchsorted(self.terms, terms, side) for side in ("left", "right"))
        met = np.concatenate([[0], np.cumsum(last - first)])[starts]
        out = np.zeros((len(starts) - 1, len(self.ids)))
        low = 0
        while low < len(out):
            high = max(low + 1, int(np.searchsorted(met, met[low] + SCORED_ENTRIES, "right")) - 1)
            own = slice(starts[low], starts[high])
            n = last[own] - first[own]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)
            query = np.repeat(np.repeat(np.arange(high - low), np.diff(starts[low:high + 1])), n)
            out[low:high] = np.bincount(query * len(self.ids) + self.places[entry], np.repeat(weights[own], n) * part[entry],
                                        (high - low) * len(self.ids)).reshape(high - low, -1)
            low = high
        return out


_BLOCK = ("ids array<bigint>, dl array<int>, postings array<bigint>, places array<int>, tf array<int>, "
          "vectors array<double>")


def _cell(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy(zero_copy_only=False)


def _block_of(batch: pa.RecordBatch, k: int) -> DocBlock:
    return DocBlock.of({c: _cell(batch, c, k) for c in ("ids", "dl", "postings", "places", "tf", "vectors")})


def _doc_blocks(latent: LatentModel | None, doc_rows: int, doc_terms: int):
    def block(held):
        held.sort(key=lambda h: h[0])
        ids, dl, terms, tf, vectors = zip(*held)
        places = np.repeat(np.arange(len(held)), [len(t) for t in terms])
        cells = [(np.array(ids), pa.int64()), (np.array(dl), pa.int32()), (np.concatenate(terms), pa.int64()),
                 (places, pa.int32()), (np.concatenate(tf), pa.int32()), (np.concatenate(vectors), pa.float64())]
        return pa.RecordBatch.from_arrays([list_array(pa.array(x, kind), [len(x)]) for x, kind in cells],
                                          names=["ids", "dl", "postings", "places", "tf", "vectors"])

    def run(batches):
        held, n = [], 0
        for batch in slices_of(batches):
            vectors = latent.embed(arrays_of(batch.column(2))) if latent else np.zeros((batch.num_rows, 0))
            for doc, tokens, vector in zip(batch.column(0).to_pylist(), arrays_of(batch.column(1)), vectors):
                terms, tf = np.unique(tokens, return_counts=True)
                held.append((doc, len(tokens), terms, tf, vector))
                n += len(terms)
                if len(held) >= doc_rows or n >= doc_terms:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)
    return run


@dataclass(frozen=True)
class BlockIndex:
    """A catalogue in blocks, with what BM25 needs of the whole."""
    blocks: DataFrame
    latent: LatentModel | None
    n_docs: int
    avg: float


def build_blocks(docs: DataFrame, latent: LatentModel | None = None, with_latent: bool = True, doc_rows: int = DOC_ROWS,
                 doc_terms: int = DOC_TERMS) -> BlockIndex:
    """Index of ``docs`` (doc_id, a whole number; text). Each text is tokenised once for its block.

    A null text is empty. Repeated ids are documents of their own. An empty catalogue finds nothing.
    """
    if with_latent and latent is None:
        latent = fit_latent(docs)
    text = F.coalesce("text", F.lit(""))
    grams = gram_hashes(text) if latent else F.array().cast("array<bigint>")
    rows = spread(docs).select(F.col("doc_id").cast("bigint"), term_hashes(text).alias("t"), grams.alias("g"))
    blocks = stage(rows.mapInArrow(_doc_blocks(latent, doc_rows, doc_terms), _BLOCK).withColumn(
        "block", F.monotonically_increasing_id()), "blocks", FILE_BLOCKS)
    total = F.aggregate("dl", F.lit(0).cast("bigint"), lambda a, x: a + x)
    r = blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum(total).alias("t")).first()
    return BlockIndex(blocks, latent, r["n"] or 0, (r["t"] or 0) / max(r["n"] or 0, 1))


def join_on_term(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Rows with what ``side`` has for their term, one row a term; no frequent term gathers in a task.

    A small side is broadcast. Else terms that hold more than a share of the rows, which are at most as many
    as the share allows, are found first and their part of the side is broadcast; only the others are
    shuffled. ``rows`` is read up to three times and should be staged.
    """
    if is_small(side):
        return rows.join(F.broadcast(side), "term")
    n = rows.count()
    hot = stage(rows.groupBy("term").count().where(F.col("count") > n * HOT_TERM_SHARE).select("term"), "hot-terms")
    frequent = rows.join(F.broadcast(side.join(F.broadcast(hot), "term", "left_semi")), "term")
    return frequent.union(rows.join(F.broadcast(hot), "term", "left_anti").join(side, "term").select(frequent.columns))


def with_idf(df: DataFrame, index: BlockIndex) -> DataFrame:
    """``(term, idf)`` of ``(term, df)``."""
    n = F.lit(float(index.n_docs))
    return df.select("term", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))


def hashed_queries(queries: DataFrame, index: BlockIndex) -> DataFrame:
    """``(query_id, t, g)``: hashes of the words, and of the words and pairs if the index has latent vectors."""
    text = F.coalesce("text", F.lit(""))
    return queries.select("query_id", term_hashes(text).alias("t"),
                          (gram_hashes(text) if index.latent else F.array().cast("array<bigint>")).alias("g"))


def query_vectors(latent: LatentModel | None, batch: pa.RecordBatch) -> np.ndarray:
    return latent.embed(arrays_of(batch.column(2))) if latent else np.zeros((batch.num_rows, 0))


def query_rows(queries: DataFrame, index: BlockIndex) -> DataFrame:
    """``(query_id, terms, weights, v)`` of queries (query_id, text): known terms with count times idf."""
    shared = queries.sparkSession.sparkContext.broadcast(index.latent)
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        for batch in slices_of(batches):
            terms, tf = zip(*(np.unique(t, return_counts=True) for t in arrays_of(batch.column(1))))
            vectors = query_vectors(shared.value, batch)
            found = pa.StructArray.from_arrays([pa.array(np.concatenate(terms), pa.int64()), pa.array(np.concatenate(tf), pa.int32())],
                                               names=["term", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(found, [len(t) for t in terms]),
                 list_array(pa.array(vectors.reshape(-1), pa.float64()), [vectors.shape[1]] * batch.num_rows)],
                names=["query_id", "found", "v"])

    rows = stage(hashed_queries(queries, index).mapInArrow(
        run, f"query_id {kind}, found array<struct<term: bigint, n: int>>, v array<double>"), "query-terms")
    used = rows.select("query_id", F.explode("found").alias("f")).select("query_id", "f.term", "f.n")
    wanted = stage(used.select("term").distinct(), "wanted")
    # of the documents, only the count of each term leaves its task
    df = join_on_term(index.blocks.select(F.explode("postings").alias("term")), wanted).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = stage(with_idf(df, index), "idf")
    weighted = join_on_term(used, idf).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("term", (F.col("n") * F.col("idf")).alias("w")))).alias("k"))
    known = F.coalesce("k", F.array().cast("array<struct<term: bigint, w: double>>"))
    return rows.select("query_id", "v").join(broadcast_if_small(weighted), "query_id", "left").select(
        "query_id", F.transform(known, lambda x: x["term"]).alias("terms"), F.transform(known, lambda x: x["w"]).alias("weights"), "v")


# ---------------------------------------------------------------- meeting

def _starts(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _matrices(queries: tuple, block: DocBlock, avg: float):
    """BM25 and cosines of queries, given as (starts, terms, weights, vectors), and the documents of a block."""
    *known, vectors = queries
    width = min(vectors.shape[1], block.vectors.shape[1])
    return block.bm25(*known, avg), vectors[:, :width] @ block.vectors[:, :width].T


def _ends(b: np.ndarray, l: np.ndarray) -> np.ndarray:
    return np.stack([b.min(axis=1), b.max(axis=1), l.min(axis=1), l.max(axis=1)], axis=1)


def _widened(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where([True, False, True, False], np.minimum(a, b), np.maximum(a, b))


def _scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    width = (high - low)[:, None]
    return np.where(width < 1e-10, 0.5, (x - low[:, None]) / np.where(width < 1e-10, 1.0, width))


@dataclass(frozen=True)
class Blend:
    """How two scores make one, and the digits it is compared in (None: all)."""
    latent: float = fv.LSA_WEIGHT
    lexical: float = fv.BM25_WEIGHT
    digits: int | None = None

    def best(self, b, l, ends, ids) -> list[np.ndarray]:
        """Blended score, lexical, latent and id of each query's best document, the least id on ties."""
        b, l = _scaled(b, ends[:, 0], ends[:, 1]), _scaled(l, ends[:, 2], ends[:, 3])
        h = l * self.latent + b * self.lexical
        h = h if self.digits is None else np.round(h, self.digits)
        at = h.argmax(axis=1)  # ids rise, so the first is the least
        row = np.arange(len(h))
        return [h[row, at], b[row, at], l[row, at], ids[at]]


def _better(new: list[np.ndarray], old: list[np.ndarray]) -> list[np.ndarray]:
    wins = (new[0] > old[0]) | (new[0] == old[0]) & (new[3] < old[3])
    return [np.where(wins, a, b) for a, b in zip(new, old)]


def _result(ids: pa.Array, best, matched) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(best[3], pa.int64()), pa.array(best[1]), pa.array(best[2]), pa.array(best[0]),
                                       pa.array(matched)], names=["query_id", "doc_id", "bm25_score", "lsa_score", "hybrid_score", "matched"])


def retrieve(queries: DataFrame, index: BlockIndex, blend: Blend = Blend(), limit: int = BROADCAST_BYTES,
             query_rows_: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, doc_id, bm25_score, lsa_score, hybrid_score, matched)``: the best document of every query.

    Both scores are scaled to [0, 1] over the whole catalogue for each query, all equal ones to 0.5. A query
    that shares no term with any document is not ``matched``. ``queries`` has query_id, which is unique, and text.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, doc_id bigint, bm25_score double, lsa_score double, hybrid_score double, matched boolean"
    if not index.n_docs:
        return queries.sparkSession.createDataFrame([], schema)
    cells = F.size("postings") * 16 + F.size("ids") * 12 + F.size("vectors") * 8
    if (index.blocks.agg(F.sum(cells)).first()[0] or 0) <= limit:
        return _beside_queries(queries, index, blend, schema)
    return _beside_blocks(stage(query_rows(queries, index), "query-rows"), index, blend, schema, kind, query_rows_)


def _beside_queries(queries: DataFrame, index: BlockIndex, blend: Blend, schema: str) -> DataFrame:
    """The catalogue, whose size is proven, goes to the queries: nothing is shuffled, nothing is written.

    Of a query, only the terms that the catalogue knows are kept, and these but for a group of queries at a time.
    """
    df = index.blocks.select(F.explode("postings").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = with_idf(df, index).orderBy("term").toArrow()
    blocks = index.blocks.toArrow().combine_chunks().to_batches()
    shared = queries.sparkSession.sparkContext.broadcast((
        idf["term"].to_numpy(), idf["idf"].to_numpy(), index.latent, [_block_of(b, k) for b in blocks for k in range(b.num_rows)]))
    avg = index.avg

    def weighted(batch, known, idf, latent):
        texts, sizes = arrays_of(batch.column(1)), []
        terms, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        for tokens in texts:
            term, n = np.unique(tokens, return_counts=True)
            at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            hit = known[at] == term if len(known) else np.zeros(len(term), bool)
            terms.append(term[hit])
            weights.append(n[hit] * idf[at[hit]])
            sizes.append(int(hit.sum()))
        return _starts(sizes), np.concatenate(terms), np.concatenate(weights), query_vectors(latent, batch)

    def run(batches):
        known, idf, latent, blocks = shared.value
        for part in slices_of(batches, QUERY_ROWS):
            queries = weighted(part, known, idf, latent)
            ends = best = None
            for block in blocks:
                own = _ends(*_matrices(queries, block, avg))
                ends = own if ends is None else _widened(ends, own)
            for block in blocks:
                own = blend.best(*_matrices(queries, block, avg), ends, block.ids)
                best = own if best is None else _better(own, best)
            yield _result(part.column(0), best, ends[:, 1] > 0)

    return hashed_queries(queries, index).mapInArrow(run, schema)


def _beside_blocks(rows: DataFrame, index: BlockIndex, blend: Blend, schema: str, kind: str, query_rows_: int) -> DataFrame:
    """Groups of queries come to the blocks, first for the ends of the scores, then for the best documents."""
    n_groups = max(1, -(-rows.count() // query_rows_))
    group = F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("group")
    avg = index.avg

    def met(frame: DataFrame) -> DataFrame:
        packed = frame.groupBy(group).agg(F.collect_list(F.struct(*frame.columns)).alias("q"))
        packed = stage(packed.select("group", *(F.col(f"q.{c}").alias(c) for c in frame.columns)), "groups")
        each = index.blocks.withColumn("group", F.explode(F.expr(f"sequence(0L, {n_groups - 1}L)")))
        return each.join(broadcast_if_small(packed, max(1, 4096 // query_rows_)), "group")

    def pairs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lists = {c: arrays_of(batch.column(c)[k].values) for c in ("terms", "weights", "v", "ends") if c in batch.schema.names}
                terms = lists["terms"]
                queries = (_starts([len(t) for t in terms]), np.concatenate(terms), np.concatenate(lists["weights"]),
                           np.stack(lists["v"]))
                yield batch.column("query_id")[k].values, lists.get("ends"), queries, _block_of(batch, k)

    def find_ends(batches):
        for ids, _, queries, block in pairs(batches):
            found = _ends(*_matrices(queries, block, avg))
            yield pa.RecordBatch.from_arrays([ids, list_array(pa.array(found.reshape(-1)), [4] * len(ids))], names=["query_id", "e"])

    def find_best(batches):
        for ids, ends, queries, block in pairs(batches):
            ends = np.stack(ends)
            yield _result(ids, blend.best(*_matrices(queries, block, avg), ends, block.ids), ends[:, 1] > 0)

    e = met(rows).mapInArrow(find_ends, f"query_id {kind}, e array<double>")
    ends = e.groupBy("query_id").agg(F.array(*(f(F.col("e")[i]) for i, f in enumerate((F.min, F.max, F.min, F.max)))).alias("ends"))
    best = met(rows.join(stage(ends, "ends"), "query_id")).mapInArrow(find_best, schema)
    fields = [c for c in best.columns if c != "query_id"]
    rank = F.struct("hybrid_score", -F.col("doc_id"))
    return best.groupBy("query_id").agg(F.max_by(F.struct(*fields), rank).alias("b")).select("query_id", "b.*")
