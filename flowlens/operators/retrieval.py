"""BM25, TF-IDF and nearest vectors; the blend with latent vectors is in ``blocks``.

Two shapes occur. A *catalogue* is matched by any number of query rows: a small one is broadcast
and each query row gets an array of scores, a larger one is met block by block. A *corpus* is large
and searched by a smaller set of queries: only tokens that some query uses leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.text import whitespace_tokens, word_tokens
from flowlens.functions.vectors import dot, first_max, l2_normalise, min_max
from flowlens.operators.blocks import BlockIndex, Blend, build_blocks, join_on_term, retrieve, term_hashes
from flowlens.operators.latent import LatentModel, arrays_of, counted, fit_latent, latent_embedding, list_array, lookup, slices_of
from flowlens.session import broadcast_if_small, is_small, stage

__all__ = ["BlockIndex", "LatentModel", "fit_latent", "latent_embedding", "build_hybrid_index", "hybrid_retrieve"]

CATALOGUE_LIMIT = 256
TERM_SALTS = 64


# ---------------------------------------------------------------- statistics of a corpus

def document_lengths(docs: DataFrame) -> DataFrame:
    """``(doc_id, tokens, dl)``; the token array is made in the row, nothing moves."""
    return docs.select("doc_id", whitespace_tokens(F.col("text")).alias("tokens")).withColumn(
        "dl", F.size("tokens"))


def corpus_size(lengths: DataFrame) -> Column:
    """Number of documents and mean length, as one scalar struct."""
    return lengths.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"),
                                F.avg("dl").alias("avg"))).scalar()


def document_frequency(lengths: DataFrame) -> DataFrame:
    """Documents per term. Each document lists a term once, so a plain count is enough."""
    terms = lengths.select(F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_idf(df: Column, n: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_index(docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` of the whole corpus."""
    lengths = document_lengths(docs)
    return document_frequency(lengths).withColumn(
        "idf", bm25_idf(F.col("df"), corpus_size(lengths)["n"]))


def bm25_weight(tf: Column, dl: Column, avg: Column, idf: Column, k1: float = fv.BM25_K1,
                b: float = fv.BM25_B) -> Column:
    """What one occurrence of a term in a query adds to a document's score."""
    return idf * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avg)))


# ---------------------------------------------------------------- large corpus, few queries

def bm25_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, doc_id, bm25)`` for pairs that share a term.

    Documents are tokenised once: the counts of terms that some query uses are written with the
    documents' lengths. Document counts, their number and the matches are read from there. Terms are
    64-bit hashes. Frequent ones, of the documents as of the queries, never gather in a task (see
    ``join_on_term``).
    """
    wanted = stage(queries.select("query_id", F.explode(term_hashes(F.col("text"))).alias("term"))
                   .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "query-terms")
    vocabulary = stage(wanted.select("term").distinct(), "query-vocabulary")
    lengths = docs.select("doc_id", F.coalesce(term_hashes(F.col("text")), F.array().cast("array<bigint>")).alias("tokens"))
    lengths = lengths.select("doc_id", F.size("tokens").alias("dl"), "tokens")
    if is_small(vocabulary):
        lengths = stage(only_terms(lengths, vocabulary), "document-terms")
        tf = lengths.select("doc_id", "dl", F.explode("found").alias("f")).select("doc_id", "dl", "f.term", "f.tf")
    else:
        lengths = stage(lengths, "tokens")
        each = stage(lengths.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term")
                     .agg(F.count(F.lit(1)).alias("tf")), "document-terms")
        tf = stage(join_on_term(each, vocabulary), "known-terms")
    size = corpus_size(lengths)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = stage(df.select("term", bm25_idf(F.col("df"), size["n"]).alias("idf")), "idf")
    weights = stage(join_on_term(wanted, idf), "query-weights")
    score = F.col("qtf") * bm25_weight(F.col("tf"), F.col("dl"), size["avg"], F.col("idf"))
    if is_small(weights):
        pairs = tf.join(F.broadcast(weights), "term")
    else:
        salted = weights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
        pairs = tf.withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(TERM_SALTS))).join(salted, ["term", "_salt"])
    return pairs.groupBy("query_id", "doc_id").agg(F.sum(score).alias("bm25"))


def only_terms(lengths: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, dl, found)``: terms of a small, proven vocabulary with their counts, made where the document lies."""
    hashes = lengths.sparkSession.sparkContext.broadcast([r["term"] for r in vocabulary.collect()] or [0])
    kind = lengths.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, place = lookup(hashes.value)
        for batch in slices_of(batches):
            text, at, tf = counted(arrays_of(batch.column(2)), known, place)
            entry = pa.StructArray.from_arrays([pa.array(np.array(hashes.value, np.int64)[at]), pa.array(tf.astype(np.int64))],
                                               names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(entry, np.bincount(text, minlength=batch.num_rows))],
                                             names=["doc_id", "dl", "found"])

    return lengths.mapInArrow(run, f"doc_id {kind}, dl int, found array<struct<term: bigint, tf: bigint>>")


def best_match(matches: DataFrame, score: str, digits: int = 6) -> DataFrame:
    """Best document per query; the lowest id on ties of the rounded score."""
    rank = F.struct(F.round(score, digits), -F.col("doc_id"))
    return matches.groupBy("query_id").agg(
        F.max_by(F.struct("doc_id", score), rank).alias("b")).select(
        "query_id", "b.doc_id", F.round(f"b.{score}", digits).alias(score))


def min_max_by(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Min-max per group through a two-value aggregate; a constant group becomes 0.5.

    ``rows`` should be staged: it is read for the ends, for their number and for the result.
    """
    ends = broadcast_if_small(
        rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    width = F.col("_hi") - F.col("_lo")
    return rows.join(ends, list(by)).withColumn(
        out, F.when(width < 1e-10, F.lit(0.5)).otherwise((F.col(value) - F.col("_lo")) / width)
    ).drop("_lo", "_hi")


# ---------------------------------------------------------------- TF-IDF and LSA

def split_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, words)``; stage it where several passes follow, as ``word_tokens`` costs the most of each."""
    return docs.select("doc_id", word_tokens(F.col("text")).alias("words"))


def _pairs(words: DataFrame) -> DataFrame:
    """``(doc_id, a, b)``: one row per pair of neighbouring words."""
    n = F.greatest(F.size("words") - 1, F.lit(0))
    both = F.arrays_zip(F.slice("words", F.lit(1), n).alias("a"), F.slice("words", F.lit(2), n).alias("b"))
    return words.select("doc_id", F.explode(both).alias("p")).select("doc_id", "p.a", "p.b")


def known_grams(words: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per word and word pair of ``split_words`` that is one of ``terms``, which is broadcast.

    Words hold no blanks, so a term with one is a pair and is met by its two words: no pair is put together in vain.
    """
    listed = F.broadcast(terms.where(~F.contains("term", F.lit(" "))).select("term"))
    single = words.select("doc_id", F.explode("words").alias("term")).join(listed, "term", "left_semi")
    cut = F.split("term", " ")
    both = F.broadcast(terms.where(F.contains("term", F.lit(" "))).select(cut[0].alias("a"), cut[1].alias("b"), "term"))
    return single.select("doc_id", "term").unionByName(_pairs(words).join(both, ["a", "b"]).select("doc_id", "term"))


def vocabulary(docs: DataFrame, limit: int = fv.VOCABULARY_LIMIT) -> DataFrame:
    """Most frequent words and word pairs: ``(term, total)``, by count, then by term."""
    return vocabulary_of(stage(split_words(docs), "words"), limit)


def vocabulary_of(words: DataFrame, limit: int = fv.VOCABULARY_LIMIT) -> DataFrame:
    """``vocabulary`` of ``split_words``, staged.

    A pair is no more frequent than each of its words. So a pair with a word that falls short of the last of the
    ``limit`` best words is not among the best terms, and isn't counted.
    """
    single = stage(words.select(F.explode("words").alias("term")).groupBy("term")
                   .agg(F.count(F.lit(1)).alias("total")), "word-totals")
    best = single.orderBy(F.desc("total")).limit(limit).agg(F.min("total").alias("least"), F.count("*").alias("n")).first()
    pairs = _pairs(words).select("a", "b")
    often = single.where(F.col("total") >= (best["least"] if best["n"] == limit else 0))
    if is_small(often):
        for side in ("a", "b"):
            pairs = pairs.join(F.broadcast(often.select(F.col("term").alias(side))), side, "left_semi")
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("total")).select(F.concat_ws(" ", "a", "b").alias("term"), "total")
    return single.unionByName(both).orderBy(F.desc("total"), "term").limit(limit)


def smooth_idf(df: Column, n: Column) -> Column:
    return F.ln((1.0 + n) / (1.0 + df)) + 1.0


def tfidf(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, idf, weight)``, weights of unit length per document.

    ``words`` is ``split_words``, staged. ``terms`` is a vocabulary of bounded size (see ``vocabulary``), so it is
    broadcast. The counts are written once, as the document frequencies and the weights read them.
    """
    counts = stage(known_grams(words, terms)
                   .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    n = words.agg(F.count(F.lit(1)).cast("double")).scalar()
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", smooth_idf(F.col("df"), n).alias("idf"))
    raw = counts.join(F.broadcast(idf), "term").withColumn(
        "_w", (1.0 + F.ln("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", "tf", "idf", (F.col("_w") / length).alias("weight"))


# ---------------------------------------------------------------- catalogue, many queries

def build_hybrid_index(texts: DataFrame) -> BlockIndex:
    """Index of a catalogue (doc_id, text) of any size."""
    return build_blocks(texts)


def hybrid_retrieve(queries: DataFrame, index: BlockIndex, lsa_weight: float = fv.LSA_WEIGHT,
                    bm25_weight_: float = fv.BM25_WEIGHT) -> DataFrame:
    """Best catalogue document per query with its three normalised scores.

    A query that matches nothing scores 0.5 throughout and falls to the first document;
    ``matched`` tells it apart.
    """
    return retrieve(queries, index, Blend(lsa_weight, bm25_weight_))


def bm25_best(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """``(query_id, doc_id, bm25_score, matched)`` with BM25 alone, one half of the blend.

    Within the limit every query row gets its scores as an array; beyond it the blocks are met.
    """
    if is_small(texts, CATALOGUE_LIMIT):
        n = texts.count()
        return bm25_retrieve(queries, catalogue_terms(texts, n), n)
    found = retrieve(queries, build_blocks(texts, with_latent=False), Blend(0.0, 1.0, digits=6))
    return found.select("query_id", "doc_id", F.round("bm25_score", 6).alias("bm25_score"), "matched")


def catalogue_terms(texts: DataFrame, n_docs: int) -> DataFrame:
    """``(term, w)``: what one occurrence in a query adds to each document's BM25 score.

    ``doc_id`` must be 0 .. n_docs - 1. At most one row per catalogue term.
    """
    lengths = document_lengths(texts)
    size = corpus_size(lengths)
    df = document_frequency(lengths)
    tf = (lengths.select("doc_id", "dl", F.explode("tokens").alias("term"))
          .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    weight = bm25_weight(F.col("tf"), F.col("dl"), size["avg"],
                         bm25_idf(F.col("df"), size["n"]))
    each = tf.join(df, "term").select("term", "doc_id", weight.alias("w"))
    return each.groupBy("term").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("doc_id") == d, F.col("w"))), F.lit(0.0))
        for d in range(n_docs)]).alias("w"))


def catalogue_bm25(queries: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """``(query_id, bm25)`` with one raw score per catalogue document.

    The catalogue's terms are broadcast; each query's tokens are summed before the shuffle,
    so one short row per query moves.
    """
    tokens = queries.select("query_id",
                            F.explode_outer(whitespace_tokens(F.col("text"))).alias("term"))
    hit = tokens.join(broadcast_if_small(terms), "term", "left")
    sums = hit.groupBy("query_id").agg(*[
        F.sum(F.coalesce(F.col("w")[d], F.lit(0.0))).alias(f"s{d}") for d in range(n_docs)])
    return sums.select("query_id", F.array(*[f"s{d}" for d in range(n_docs)]).alias("bm25"))


def bm25_retrieve(queries: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """Same with BM25 alone (one half of the blend)."""
    raw = catalogue_bm25(queries, terms, n_docs)
    scored = raw.select("query_id", (F.array_max("bm25") > 0).alias("matched"),
                        F.transform(min_max(F.col("bm25")), lambda x: F.round(x, 6)).alias("b"))
    best = first_max(F.col("b"))
    return scored.select("query_id", (best - 1).alias("doc_id"),
                         F.element_at("b", best).alias("bm25_score"), "matched")


# ---------------------------------------------------------------- dense vectors

def cosine_to_catalogue(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Cosine of every query vector to each catalogue vector: ``(query_id, label, cosine)``.

    The catalogue (``label, v``) travels in arrays of at most ``CATALOGUE_LIMIT`` vectors, so that
    only the cells, which are the result, grow with queries times catalogue.
    """
    return _cosine_arrays(queries, catalogue).select("query_id", F.explode("cells").alias("c")).select(
        "query_id", "c.label", "c.cosine")


def _cosine_arrays(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(query_id, cells)``: label and cosine of each vector of an array of the catalogue, by label.

    A small catalogue is one array, and each query has one row; a larger one is dealt into arrays by the
    hash of the label, each of which meets each query.
    """
    unit = catalogue.select(F.struct("label", l2_normalise(F.col("v")).alias("v")).alias("d"))
    q = queries.select("query_id", l2_normalise(F.col("v")).alias("q"))
    if is_small(catalogue, CATALOGUE_LIMIT):
        docs = unit.agg(F.sort_array(F.collect_list("d")).alias("docs")).scalar()
        both = q.select("query_id", "q", docs.alias("docs"))
    else:
        # a stated set of queries against blocks of the whole catalogue
        n_blocks = -(-catalogue.count() // (CATALOGUE_LIMIT // 2))
        part = F.pmod(F.xxhash64("d.label"), F.lit(n_blocks)).alias("part")
        docs = stage(unit.groupBy(part).agg(F.sort_array(F.collect_list("d")).alias("docs")), "vectors")
        each = q.withColumn("part", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")))
        both = each.join(broadcast_if_small(docs, CATALOGUE_LIMIT), "part")
    return both.select("query_id", F.transform("docs", lambda d: F.struct(
        d["label"].alias("label"), dot(F.col("q"), d["v"]).alias("cosine"))).alias("cells"))


def nearest_in_catalogue(queries: DataFrame, catalogue: DataFrame, digits: int = 6) -> DataFrame:
    """``(query_id, label, cosine)`` of the closest vector, found inside the row.

    Cosines are compared as rounded; the least label wins ties.
    """
    cells = _cosine_arrays(queries, catalogue).select("query_id", F.transform("cells", lambda c: F.struct(
        c["label"].alias("label"), F.round(c["cosine"], digits).alias("cosine"))).alias("cells"))
    best = first_max(F.transform("cells", lambda c: c["cosine"]))
    found = cells.select("query_id", F.element_at("cells", best).alias("c"))
    if not is_small(catalogue, CATALOGUE_LIMIT):
        least = F.min(F.struct((-F.col("c.cosine")).alias("far"), F.col("c.label").alias("label")))
        found = found.groupBy("query_id").agg(least.alias("m")).select(
            "query_id", F.struct(F.col("m.label").alias("label"), (-F.col("m.far")).alias("cosine")).alias("c"))
    return found.select("query_id", "c.label", "c.cosine")
