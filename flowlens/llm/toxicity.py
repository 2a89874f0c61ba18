"""Toxicity by a logistic model of words that is indifferent to which group a text names."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import broadcast_below, crc_of_id, small_batches, spread_rows, stage
from flowlens.llm.decontaminate import plain_words

#: Labelled rows of the fit, and words of the model. Both bound what reaches the driver.
SAMPLE_ROWS = 30_000
VOCABULARY = 4096
#: How much rarer than under independence a word's split over the classes must be (chi-square).
LEAST_CHI2 = 12.0
LEAST_TOXIC = 3
#: Weight of squared weights, and of squared score changes under a swap.
RIDGE = 2e-4
SWAP_PENALTY = 1.0
THRESHOLD = 0.7

# Terms that name groups, by kind; the first of a kind is its neutral member.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "immigrants", "refugees", "foreigners", "americans", "mexicans",
     "chinese", "africans", "arabs", "europeans", "blacks", "whites", "asians", "latinos", "natives"),
    ("person", "woman", "man", "girl", "boy", "immigrant", "refugee", "foreigner"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("human", "black", "white", "asian", "latino", "african", "arab", "american", "mexican", "european"),
    ("adult", "gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("citizen", "disabled", "blind", "deaf", "autistic"),
)


def swaps(kinds=IDENTITY_TERMS) -> dict[bytes, bytes]:
    """Each term to the next of its kind, the last to the first."""
    return {a.encode(): b.encode() for kind in kinds for a, b in zip(kind, (*kind[1:], kind[0]))}


def features(text: str | None) -> set[bytes]:
    """The words of a text, and each beginning that two or more different words of it share.

    Beginnings of 4 to 7 letters, marked by a line feed, stand for stems in languages that compound.
    """
    words = set(plain_words(text))
    stems: set[bytes] = set()
    once: set[bytes] = set()
    for word in words:
        letters = word.decode("utf-8", "surrogatepass")
        for k in range(4, min(len(letters), 8)):
            stem = b"\n" + letters[:k].encode("utf-8", "surrogatepass")
            (stems if stem in once else once).add(stem)
    return words | stems


def counterfactuals(text: str | None, terms: dict[bytes, bytes]) -> list[set[bytes]]:
    """Features with every term that names a group replaced by another, and with none of them.

    The second keeps a model from raising the weights of all terms alike. No list without such a term.
    """
    words = plain_words(text)
    if not any(w in terms for w in words):
        return []
    of = lambda kept: features(b" ".join(kept).decode("utf-8", "surrogatepass"))
    return [of(terms.get(w, w) for w in words), of(w for w in words if w not in terms)]


@dataclass
class ToxicModel:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: str | None) -> float:
        """Probability from which words and stems occur; how often they do doesn't count."""
        known = self.weights
        z = self.bias + math.fsum(known[w] for w in features(text) if w in known)
        return 1.0 / (1.0 + math.exp(-min(max(z, -60.0), 60.0)))


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, swapped: list[list[np.ndarray]], size: int,
                 ridge: float = RIDGE, penalty: float = SWAP_PENALTY, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of words, from the words of each row and of its counterparts with terms swapped.

    Minimises log loss, in which the classes weigh alike, + ridge * |w|^2 / 2 + penalty * mean squared
    change of the score under a swap, by Newton steps solved with conjugate gradients. With one class
    only, the smoothed rate and no weights.
    """
    n = len(rows)
    if not n or labels.min() == labels.max():
        rate = (labels.sum() + 1.0) / (n + 2.0) if n else 0.5
        return np.zeros(size), math.log(rate / (1 - rate))
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    word = np.concatenate(rows).astype(np.int64)
    pairs = [(i, s) for i, others in enumerate(swapped) for s in others]
    m = max(len(pairs), 1)
    of = np.concatenate([np.full(len(rows[i]) + len(s), k) for k, (i, s) in enumerate(pairs)] or [[]]).astype(np.int64)
    moved = np.concatenate([np.concatenate([rows[i], s]) for i, s in pairs] or [[]]).astype(np.int64)
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(rows[i]), len(s)]) for i, s in pairs] or [[]])
    share = labels.mean()
    mass = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n
    scores = lambda v: np.bincount(at, v[:-1][word], n) + v[-1]
    changes = lambda v: np.bincount(of, sign * v[:-1][moved], m)
    back = lambda g, d: np.append(
        np.bincount(word, g[at], size) + 2 * penalty / m * np.bincount(moved, sign * d[of], size), g.sum())
    flat = np.append(np.full(size, ridge), 1e-9)

    def loss(v):
        z, d = scores(v), changes(v)
        return mass @ (np.logaddexp(0, z) - labels * z) + flat @ (v * v) / 2 + penalty / m * (d @ d)

    v = np.zeros(size + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(scores(v), -60, 60)))
        curve = mass * p * (1 - p)
        gradient = back(mass * (p - labels), changes(v)) + flat * v
        if np.abs(gradient).max() < 1e-9:
            break
        step, rest = np.zeros_like(v), -gradient
        way, was = rest, rest @ rest
        for _ in range(100):
            bent = back(curve * scores(way), changes(way)) + flat * way
            far = was / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            now = rest @ rest
            if now < 1e-6 * (gradient @ gradient):
                break
            way, was = rest + now / was * way, now
        size_, before = 1.0, loss(v)
        while size_ > 1e-6 and loss(v + size_ * step) > before:
            size_ /= 2
        v = v + size_ * step
    return v[:-1], float(v[-1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, wanted, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most about ``rows`` labelled documents, chosen by a hash of the id.

    ``wanted`` is a condition on doc_id. Ids labelled more than once take the greater label; null ids
    and null labels are left out. Labels that are chosen are broadcast, documents don't move.
    """
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(wanted)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    marked = stage(marked, "labels")
    share = min(1.0, 0.95 * rows / max(1, marked.count()))
    chosen = marked if share == 1.0 else marked.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(broadcast_below(chosen, 24), "doc_id")


def train(docs: DataFrame, labels: DataFrame, wanted, rows: int = SAMPLE_ROWS, kinds=IDENTITY_TERMS,
          penalty: float = SWAP_PENALTY, vocabulary: int = VOCABULARY) -> ToxicModel:
    """Fit on a bounded sample of the labelled rows that meet ``wanted``, a condition on doc_id.

    Words and stems that split unevenly over the classes, and the group terms that occur, make the
    vocabulary; every row that names a group has counterfactuals with these terms swapped.
    """
    terms = swaps(kinds)

    def split(batches):
        binary = pa.list_(pa.binary())
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([sorted(features(t)) for t in texts], binary),
                 pa.array([[sorted(x) for x in counterfactuals(t, terms)] for t in texts], pa.list_(binary))],
                names=["label", "own", "other"])

    sample = stage(training_rows(docs, labels, "toxic", wanted, rows).select("doc_id", "text", "label")
                   .mapInArrow(split, "label int, own array<binary>, other array<array<binary>>"), "toxic-sample")
    n, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    toxic = toxic or 0
    # only what occurs in toxic rows can speak for them; counting starts from that
    of_toxic = (sample.where("label = 1").select(F.explode("own").alias("word")).groupBy("word").count()
                .where(F.col("count") >= LEAST_TOXIC).select("word"))
    named = sample.where("size(other) > 0").select(F.explode(F.concat("own", F.flatten("other"))).alias("word")).where(
        F.col("word").isin(list(terms)))
    counts = (sample.select("label", F.explode("own").alias("word"))
              .join(broadcast_below(stage(of_toxic, "toxic-words"), 96), "word")
              .groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("t")))
    m, k = F.col("n").cast("double"), F.col("t").cast("double")
    odd = k * (n - toxic - (m - k)) - (m - k) * (toxic - k)
    chi2 = n * odd * odd / (m * (n - m) * toxic * (n - toxic) + 1e-9)
    picked = counts.where(chi2 >= LEAST_CHI2).orderBy(chi2.desc(), "word").limit(vocabulary).select("word")
    words = {bytes(r.word) for r in picked.union(named.distinct()).collect()}
    place = {word: i for i, word in enumerate(sorted(words))}

    def index(batches):
        numbers = pa.list_(pa.int32())
        known = lambda words: [place[w] for w in words if w in place]
        for batch in small_batches(batches):
            own, other = (column.to_pylist() for column in batch.columns[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([known(x) for x in own], numbers),
                 pa.array([[known(x) for x in y] for y in other], pa.list_(numbers))], names=["label", "own", "other"])

    data = sample.mapInArrow(index, "label int, own array<int>, other array<array<int>>").collect()
    data.sort(key=lambda r: (r.label, r.own))  # the order of rows is Spark's; sums shouldn't depend on it
    as_array = lambda x: np.array(x, dtype=np.int64)
    w, b = fit_logistic([as_array(r.own) for r in data], np.array([r.label for r in data]),
                        [[as_array(x) for x in r.other] for r in data], len(place), penalty=penalty)
    return ToxicModel({word: float(w[i]) for word, i in place.items()}, float(b))


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = shared.value
        for batch in small_batches(batches):
            score = [known.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()),
                 pa.array([int(s >= threshold) for s in score], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return (spread_rows(docs).select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), "text")
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 isn't 1 and score every document.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic; other columns are ignored. A null or
    empty text scores the bias alone. Repeated rows are scored each. Without labels, or with one class
    only, every score is the smoothed share of toxic labels. An empty table gives an empty result.
    """
    return score_toxicity(docs, train(docs, labels, crc_of_id(F.col("doc_id")) % 3 != 1))
