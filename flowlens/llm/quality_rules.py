"""Quality rules: robust multivariate outliers by minimum covariance determinant, in SQL functions.

Every language and source has its own centre and covariance of transformed text statistics, taken from
the three quarters of its documents that lie closest together; documents far off are rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.common import broadcast_hint, group_key, let, spread_rows, stage, text_of, words_of

LEAST_WORDS = 50
#: Share of a group that the covariance is taken from, and steps to find it.
CORE = 0.75
STEPS = 3
#: Documents that the language's estimate counts for in a source's, and the corpus's in a language's.
PRIOR = 50.0
#: Distances above this quantile of chi-square are outliers.
TAIL = 1e-9
#: Statistics, their transforms (see ``vector``) and the least deviation each is given.
FLOORS = {"mean_word": 0.05, "symbols": 0.035, "capitals": 0.05, "repeated": 0.12, "dup_lines": 0.15}
NAMES = tuple(FLOORS)
P = len(NAMES)
#: Cells of statistics and of distances in which quantiles are counted.
CELLS, DISTANCE_CELLS = 256.0, 32.0
GROUP_BYTES = 400


def chi_square(share: float, degrees: int) -> float:
    """Quantile, by Wilson and Hilferty's approximation."""
    z = NormalDist().inv_cdf(share)
    return degrees * (1 - 2 / (9 * degrees) + z * (2 / (9 * degrees)) ** 0.5) ** 3


def chi_square_share(value: float, degrees: int) -> float:
    return NormalDist().cdf(((value / degrees) ** (1 / 3) - 1 + 2 / (9 * degrees)) / (2 / (9 * degrees)) ** 0.5)


# ---------------------------------------------------------------- statistics of a text

def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window which occurs twice or more in the text.

    Windows are compared by 64-bit hashes. They are sorted with their places, neighbours that agree
    name the places, and the places' gaps tell how many words they cover: no pairs, no per-row search.
    """
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def places(sorted_: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == F.get(sorted_, other)["h"], F.lit(False))
        hit = F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        with_place = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h),
                      let(let(F.sort_array(with_place), places), covered)).otherwise(F.lit(0).cast("long"))

    return let(hashes, count)


def base_statistics(text: Column) -> Column:
    """Structure of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals."""
    only = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (
        F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return let(words_of(text), lambda w: let(of_lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"), x["dup"].alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
        x["n"].alias("n_lines"), only("A-Z").alias("n_capitals"))))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """Transformed statistics: the logarithm of a length, square roots of shares."""
    share = lambda a, b: F.when(s[b] > 0, F.sqrt(s[a].cast("double") / s[b])).otherwise(F.lit(0.0))
    length = F.when(s["n_words"] > 0, F.log1p(s["word_chars"].cast("double") / s["n_words"])).otherwise(F.lit(0.0))
    return [length, share("n_symbols", "word_chars"), share("n_capitals", "word_chars"),
            share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")]


# ---------------------------------------------------------------- robust estimates

def _pairs():
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _quantiles(counts: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """The least cell of ``value`` at which each share of a group's ``n`` is reached.

    A group has as many rows as cells, whatever its documents are.
    """
    run = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    cum = counts.withColumn("_cum", F.sum("n").over(run)).withColumn("_all", F.sum("n").over(whole))
    return cum.groupBy(*by).agg(*(F.min(F.when(F.col("_cum") >= F.ceil(F.lit(q) * F.col("_all")), F.col(value)))
                                  .alias(f"q{k}") for k, q in enumerate(shares)))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges as first centres and spreads."""
    cells = F.posexplode(F.array(*(F.round(F.col(f"x{i}") * CELLS).cast("int") for i in range(P)))).alias("f", "cell")
    counts = rows.select("lang_key", "key", cells).groupBy("lang_key", "key", "f", "cell").agg(F.count("*").alias("n"))
    q = _quantiles(counts, ["lang_key", "key", "f"], "cell", [0.25, 0.5, 0.75])
    of = lambda i, c: F.max(F.when(F.col("f") == i, c))
    floors = list(FLOORS.values())
    spread = [F.greatest((F.col("q2") - F.col("q0")) / (1.349 * CELLS), F.lit(floors[i])) for i in range(P)]
    return q.groupBy("lang_key", "key").agg(
        *(of(i, F.col("q1") / CELLS).alias(f"m{i}") for i in range(P)),
        *((of(i, 1 / spread[i]) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in _pairs()))


def _distance(x: str = "x") -> Column:
    """Squared Mahalanobis distance: the centred vector times the inverse Cholesky factor, squared."""
    z = [sum((F.col(f"w{i}{j}") * (F.col(f"{x}{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((a * a for a in z), F.lit(0.0))


def _whiten(moments: DataFrame) -> DataFrame:
    """Centre and inverse Cholesky factor from shrunk sums n, s_i, s_ij; one column after the other."""
    df = moments.select("*", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)))
    floors = list(FLOORS.values())
    for i, j in _pairs():
        cov = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit(floors[i] ** 2) if i == j else 0.0)
        rest = cov - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    for i, j in _pairs():
        w = 1 / F.col(f"l{i}{i}") if i == j else -sum(
            (F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
        df = df.withColumn(f"w{i}{j}", w)
    return df.select("lang_key", "key", *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in _pairs()))


def _shrunk(moments: DataFrame, hint=F.broadcast) -> DataFrame:
    """Sums of a group with those of its language, scaled to ``PRIOR`` documents, and so on to the corpus."""
    sums = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}{j}" for i, j in _pairs())]
    langs = moments.groupBy("lang_key").agg(*(F.sum(c).alias(c) for c in sums))
    corpus = langs.agg(*(F.sum(c).alias(f"c_{c}") for c in sums))  # one row
    langs = langs.crossJoin(F.broadcast(corpus)).select("lang_key", *(
        (F.col(c) + PRIOR * F.col(f"c_{c}") / F.col("c_n")).alias(f"l_{c}") for c in sums))
    return moments.join(hint(langs), "lang_key").select("lang_key", "key", *(
        (F.col(c) + PRIOR * F.col(f"l_{c}") / F.col("l_n")).alias(c) for c in sums))


def _moments(rows: DataFrame) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(P)]
    return rows.groupBy("lang_key", "key").agg(
        F.count("*").cast("double").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)),
        *(F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in _pairs()))


def _at(rows: DataFrame, params: DataFrame, hint=F.broadcast) -> DataFrame:
    """Rows with their group's estimate and distance; no shuffle while the groups fit a broadcast."""
    met = rows.join(hint(params.drop("lang_key")), "key")
    return met.withColumn("d", _distance())


def estimate(rows: DataFrame) -> tuple[DataFrame, Callable]:
    """The estimates, and the hint for joins with them, for which groups are counted once. Per group: centre m_i and factor w_ij, so that distances follow chi-square on regular documents.

    ``rows`` has lang_key, key and x_0.. of the documents to learn from. Each step counts distances in
    cells, takes the documents within the core share, and sums their moments: two aggregates that
    combine before the shuffle. The last steps set the scale by the core quantile and take in all
    documents up to the 97.5 % quantile.
    """
    cell = F.floor(DISTANCE_CELLS * F.log2(1 + F.col("d"))).cast("int").alias("cell")
    params = stage(_start(rows), "mcd")
    hint = broadcast_hint(params, GROUP_BYTES)
    for _ in range(STEPS):
        at = _at(rows, params, hint).withColumn("cell", cell)
        core = stage(_quantiles(at.groupBy("key", "cell").agg(F.count("*").alias("n")), ["key"], "cell", [CORE]), "core")
        inside = at.join(hint(core), "key").where("cell <= q0")
        params = stage(_whiten(_shrunk(stage(_moments(inside), "moments"), hint)), "mcd")
    at = _at(rows, params, hint).withColumn("cell", cell)
    core = stage(_quantiles(at.groupBy("key", "cell").agg(F.count("*").alias("n")), ["key"], "cell", [CORE]), "core")
    scale = (F.pow(F.lit(2.0), (F.col("q0") + 1) / DISTANCE_CELLS) - 1) / chi_square(CORE, P)
    cut = chi_square(0.975, P)
    inside = at.join(hint(core), "key").where(F.col("d") <= cut * F.greatest(scale, F.lit(1.0)))
    # the covariance of what lies inside the cut is too small by this
    factor = (0.975 / chi_square_share(cut, P + 2)) ** -0.5
    params = _whiten(_shrunk(stage(_moments(inside), "moments"), hint))
    return stage(params.select("lang_key", "key", *(f"m{i}" for i in range(P)), *(
        (F.col(f"w{i}{j}") * factor).alias(f"w{i}{j}") for i, j in _pairs())), "mcd"), hint


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` as structure ``__row``, with ``stats``, ``failed`` and distance ``d``."""
    key = [F.col("lang").cast("string"), F.col("source").cast("string")]
    rows = spread_rows(docs).select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"), group_key(key[0]).alias("lang_key"),
        group_key(*key).alias("key"), base_statistics(text_of("text")).alias("stats"))
    rows = rows.withColumn("failed", base_failed(F.col("stats")))
    rows = stage(rows.select("*", *(v.alias(f"x{i}") for i, v in enumerate(vector(F.col("stats"))))), "rules")
    regular = rows.where("not failed").select("lang_key", "key", *(f"x{i}" for i in range(P)))
    params, hint = estimate(regular)
    # a group whose documents all fail has no estimate; its rows fail anyhow
    return rows.join(hint(params.drop("lang_key")), "key", "left").withColumn("d", _distance())


def _kept() -> Column:
    return ~F.col("failed") & F.coalesce(F.col("d") <= chi_square(1 - TAIL, P), F.lit(False))


def apply_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    One row per row of ``docs``, which needs doc_id, text, lang and source; other columns are ignored.
    Null and empty texts have zeros and fail. A null language or source is a value of its own. A group
    of few documents leans on its language's estimate and that on the corpus's. Repeated rows count,
    and are judged, each. An empty table gives an empty result. ``distance`` is the squared Mahalanobis
    distance, null where all documents of a group fail.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs, ["doc_id"]).select("__row.doc_id", *(f"stats.{c}" for c in names), F.col("failed").alias("base_failed"),
                                           _kept().alias("kept"), F.col("d").alias("distance"))


def drop_outliers(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the rules, all columns as they were. See ``apply_rules``."""
    return judged(docs, docs.columns).where(_kept()).select("__row.*")
