"""Quality by hierarchical empirical Bayes: a document's own evidence with what its site and path show.

The evidence is a logistic model of text statistics, fitted on labelled documents. Sites and paths have
Beta posteriors: a site's counts are shrunk toward the global rate, a path's toward its site, each by
the strength that the spread of their rates supports. Grouped sums of expected good documents are all
that is needed of a group, so they combine before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import broadcast_below, group_key, let, spread_rows, stage, text_of, words_of
from flowlens.llm.toxicity import training_rows

#: Labelled rows of the fit; this bounds what reaches the driver.
SAMPLE_ROWS = 30_000
#: A document stays if the probability that it is good is at least so high.
THRESHOLD = 0.5
RIDGE = 1e-3
#: Bounds of the number of documents that a prior counts for.
STRENGTH = (2.0, 10_000.0)
#: Bytes of a group's row in memory, for the bound of a broadcast.
GROUP_BYTES = 160
FEATURES = ("mean_word", "symbols", "capitals", "marks", "distinct", "repeated", "dup_lines", "log_words")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(part / whole, F.lit(1.0))).otherwise(0.0)


def statistics(text: Column) -> Column:
    """The statistics of a whole text as an array of doubles; built-in functions only."""
    chars = F.length(text).cast("double")
    only = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("double")
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("double")
        distinct = F.size(F.array_distinct(w)).cast("double")
        return F.array(F.log1p(_rate(F.length(F.array_join(w, "")).cast("double"), n * 1000.0) * 1000.0),
                       F.sqrt(_rate(only("#*$%&|<>"), chars)), F.sqrt(_rate(only("A-Z"), chars)),
                       F.sqrt(_rate(only("!?"), chars)), _rate(distinct, n), F.log1p(n / (distinct + 1.0)),
                       let(lines, lambda x: _rate((F.size(x) - F.size(F.array_distinct(x))).cast("double"),
                                                  F.size(x).cast("double"))),
                       F.log1p(n))

    return let(words, of_words)


@dataclass
class Evidence:
    """Standardised logistic model with squares of the statistics."""
    mean: list
    spread: list
    weights: list
    bias: float

    def probability(self, x: Column) -> Column:
        z = F.lit(self.bias)
        m = len(self.mean)
        for i in range(m):
            v = (F.element_at(x, i + 1) - F.lit(self.mean[i])) / F.lit(self.spread[i])
            v = F.greatest(F.least(v, F.lit(8.0)), F.lit(-8.0))
            z = z + v * F.lit(self.weights[i]) + v * v * F.lit(self.weights[m + i])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> Evidence:
    """Ridge logistic regression by Newton steps. Without rows or with one class: the smoothed rate."""
    m = len(FEATURES)
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    plain = Evidence([0.0] * m, [1.0] * m, [0.0] * 2 * m, math.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return plain
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    v = np.clip((x - mean) / spread, -8, 8)
    a = np.column_stack([v, v * v, np.ones(len(y))])
    keep = ridge * len(y) * np.eye(a.shape[1])
    keep[-1, -1] = 1e-9
    w = np.zeros(a.shape[1])
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + w @ keep @ w / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + keep, a.T @ (p - y) + keep @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return Evidence(mean.tolist(), spread.tolist(), w[:-1].tolist(), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Evidence:
    sample = training_rows(docs, labels, "quality", F.lit(True), rows)
    data = sample.select("label", statistics(text_of("text")).alias("x")).collect()
    data.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in data], dtype=float).reshape(len(data), len(FEATURES))
    return fit_evidence(x, np.array([r.label for r in data], dtype=float))


def site_of(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path. A source that is a URL has them; any other source is a host, its languages paths."""
    url = source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    host = F.when(url, F.lower(F.regexp_extract(source, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))).otherwise(source)
    path = F.when(url, F.regexp_extract(source, r"://[^/?#]*/([^/?#]*)", 1)).otherwise(lang)
    return host, path


def _strength(groups: DataFrame, prior: Column) -> float:
    """Documents that the prior counts for, by moments: the less groups differ, beyond what chance makes
    of their sizes, the more. Three sums reach the driver."""
    n, s = F.col("n"), F.col("s")
    chance = prior * (1 - prior) / n
    row = groups.agg(F.sum(n).alias("n"), F.sum(n * (F.pow(s / n - prior, 2) - chance)).alias("b"),
                     F.sum(n * prior * (1 - prior)).alias("v")).first()
    if not row.n or not row.v:
        return STRENGTH[1]
    between = max(row.b / row.n, 1e-9)
    return min(max(row.v / row.n / between - 1.0, STRENGTH[0]), STRENGTH[1])


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns ``keep`` of ``docs`` as structure ``__row``, with evidence, site_rate, path_rate, score.

    A document's own part is taken out of its path's counts, so that it isn't heard twice.
    """
    model = train(docs, labels, rows)
    host, path = site_of(F.col("source").cast("string"), F.col("lang").cast("string"))
    p = stage(spread_rows(docs).select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"), group_key(host).alias("host"),
        group_key(host, path).alias("path"), model.probability(statistics(text_of("text"))).alias("p")), "evidence")
    paths = stage(p.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = min(max((s or 0.0) / n, 1e-4), 1 - 1e-4) if n else 0.5
    k = _strength(hosts, F.lit(rate))
    hosts = hosts.select("host", ((F.lit(k * rate) + F.col("s")) / (k + F.col("n"))).alias("site_rate"))
    sites = stage(paths.join(broadcast_below(hosts, GROUP_BYTES), "host"), "sites")
    k = _strength(sites, F.col("site_rate"))
    # broadcast if few; else a shuffle join, whose hot keys adaptive execution splits
    met = p.join(broadcast_below(sites.drop("host"), GROUP_BYTES), "path")
    others = (F.lit(k) * F.col("site_rate") + F.col("s") - F.col("p")) / (F.lit(k) + F.col("n") - 1)
    bounded = lambda x: F.greatest(F.least(x, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = lambda x: x / (1 - x)
    met = met.withColumn("path_rate", bounded(others))
    joint = odds(bounded(F.col("p"))) * odds(F.col("path_rate")) / F.lit(odds(rate))
    return met.select("__row", F.col("p").alias("evidence"), "site_rate", "path_rate",
                      (joint / (1 + joint)).alias("score"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, evidence, site_rate, path_rate, score, kept), one row per row of ``docs``.

    ``docs`` needs doc_id, text, lang and source, ``labels`` doc_id and quality; other columns are
    ignored. Null and empty texts are scored by their statistics, all zero. A null source or language
    is a value of its own. Repeated rows count, and are scored, each; an id labelled twice takes the
    greater label. Without labels, or with one class only, the evidence is the smoothed share of good
    labels. An empty table gives an empty result.
    """
    out = judged(docs, labels, ["doc_id"])
    return out.select("__row.doc_id", "evidence", "site_rate", "path_rate", "score",
                      (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, all columns as they were. See ``classify_quality``."""
    return judged(docs, labels, docs.columns).where(F.col("score") >= threshold).select("__row.*")
