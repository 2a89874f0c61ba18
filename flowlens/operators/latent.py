"""Latent semantic analysis: a truncated SVD of TF-IDF rows, fitted by aggregates, applied inside the row.

Words and word pairs are hashed where they are made, so a text is tokenised once and one array of numbers per
text goes to numpy, batch by batch. The vocabulary is bounded, so what is summed over tasks is bounded, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.text import with_bigrams, word_tokens
from flowlens.session import stage

#: Texts whose words, and texts whose dense weights, Python code holds at once.
BATCH_TEXTS, DENSE_TEXTS = 256, 1000


def gram_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text and of its pairs of neighbours."""
    words = F.transform(F.array(word_tokens(text)), lambda w: with_bigrams(w))[0]
    return F.transform(words, lambda g: F.xxhash64(g))


@dataclass(frozen=True)
class LatentModel:
    """Term directions of a truncated SVD: at most 500 terms by at most 5 components."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    hashes: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.components[0]) if self.components else 0

    def embed(self, grams: list[np.ndarray]) -> np.ndarray:
        """Unit vectors of texts given as hashes; the zero vector for a text without a known term."""
        out = np.zeros((len(grams), self.rank))
        if not self.hashes or not grams:
            return out
        text, at, tf = counted(grams, *lookup(self.hashes))
        weight = (1.0 + np.log(tf)) * np.array(self.idf)[at]
        directions = np.array(self.components)[at]
        for k in range(self.rank):
            out[:, k] = np.bincount(text, weight * directions[:, k], len(grams))
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(length == 0, 1.0, length)


def lookup(hashes) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(np.array(hashes, dtype=np.int64))
    return np.array(hashes, dtype=np.int64)[order], order


def counted(grams: list[np.ndarray], known: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the known terms of texts."""
    text = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[at] == flat
    pair, tf = np.unique(text[hit] * len(known) + place[at[hit]], return_counts=True)
    return pair // len(known), pair % len(known), tf


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """Rows of an array column; null is an empty one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else []
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes) if len(column) else sizes
    return np.split(flat, np.cumsum(sizes)[:-1].astype(np.int64)) if len(column) else []


def list_array(values: pa.Array, sizes) -> pa.ListArray:
    """An array column of rows of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def slices_of(batches, rows: int = BATCH_TEXTS):
    """Arrow batches cut to few rows: working arrays are several times those of the texts."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def fit_latent(docs: DataFrame, limit: int = fv.VOCABULARY_LIMIT) -> LatentModel:
    """Truncated SVD of the TF-IDF rows of ``docs`` (doc_id, text).

    Each text is tokenised twice: for the vocabulary, and for the counts of its terms, which are written.
    Document counts of the terms and the Gramian (at most 500 x 500) are added up in the tasks, then by
    aggregates; the Gramian's leading eigenvectors, taken on the driver, are the right singular vectors.
    Each is turned so that its largest entry is positive.
    """
    from flowlens.operators.retrieval import vocabulary
    spark = docs.sparkSession
    terms = {r["h"]: r["term"] for r in vocabulary(docs, limit).select("term", F.xxhash64("term").alias("h")).collect()}
    n_docs = docs.count()
    if not terms:
        return LatentModel((), (), (), ())
    hashes = sorted(terms, key=terms.get)
    shared = spark.sparkContext.broadcast(hashes)

    def counts(batches):
        known, place = lookup(shared.value)
        for batch in slices_of(batches):
            text, at, tf = counted(arrays_of(batch.column(0)), known, place)
            sizes = np.bincount(text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([list_array(pa.array(x.astype(np.int32)), sizes) for x in (at, tf)], names=["at", "tf"])

    rows = stage(docs.select(gram_hashes(F.coalesce("text", F.lit(""))).alias("g")).mapInArrow(counts, "at array<int>, tf array<int>"), "terms")
    df = np.zeros(len(hashes))
    for r in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        df[r["at"]] = r["count"]
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0

    def gramian(batches):
        total = np.zeros((len(idf), len(idf)))
        for part in slices_of(batches, DENSE_TEXTS):
            at, tf = (arrays_of(part.column(k)) for k in range(2))
            dense = np.zeros((part.num_rows, len(idf)))
            row = np.repeat(np.arange(part.num_rows), [len(a) for a in at])
            column = np.concatenate(at).astype(np.int64)
            dense[row, column] = (1.0 + np.log(np.concatenate(tf))) * idf[column]
            length = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
            dense /= np.where(length == 0, 1.0, length)
            total += dense.T @ dense
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                         names=["i", "j", "v"])

    gram = np.zeros((len(idf), len(idf)))
    cells = rows.mapInArrow(gramian, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in cells.toLocalIterator():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    k = max(min(fv.LSA_COMPONENTS, n_docs - 1, len(hashes) - 1), 1)
    v = np.linalg.eigh(gram)[1][:, ::-1][:, :k]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return LatentModel(tuple(terms[h] for h in hashes), tuple(map(float, idf)),
                       tuple(tuple(float(x) for x in row) for row in v), tuple(hashes))


def latent_embedding(texts: DataFrame, model: LatentModel) -> DataFrame:
    """Unit vectors ``(doc_id, v)``, made where the text lies; the zero vector for a text without a known term."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices_of(batches):
            vectors = shared.value.embed(arrays_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(pa.array(vectors.reshape(-1), pa.float64()), [vectors.shape[1]] * batch.num_rows)], names=["doc_id", "v"])

    return texts.select("doc_id", gram_hashes(F.coalesce("text", F.lit(""))).alias("g")).mapInArrow(
        run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, v array<double>")
