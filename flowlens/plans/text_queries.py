"""Queries on texts and vectors: tokens, BM25, TF-IDF, latent vectors, blended retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.text import explain_query, whitespace_tokens, with_bigrams, word_tokens
from flowlens.functions.vectors import l2_normalise
from flowlens.operators import explain, retrieval as R
from flowlens.operators.windows import WINDOW_KEY
from flowlens.plans.flow_queries import (MODEL, PARAMS, SCALED, SCALES, WINDOWED, model_sql,
                                         scored_flows)
from flowlens.plans.latent_sql import hybrid_sql
from flowlens.plans.registry import query, with_ctes
from flowlens.session import broadcast_if_small, spread, stage
from flowlens.sources.catalogue import catalogue_text, threat_catalogue
from flowlens.sources.tables import FLOW_FEATURES, table

KEY = list(WINDOW_KEY)
SPACE_SQL = r"'[\t-\r\x1c-\x1f\x{85}\p{Z}]+'"
WORD_SQL = r"'[\p{L}\p{N}_]+'"


def tokens_sql(text: str) -> str:
    return f"[x FOR x IN regexp_split_to_array(lower({text}), {SPACE_SQL}) IF x <> '']"


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {WORD_SQL})"


def grams_sql(words: str) -> str:
    return (f"list_concat({words}, [{words}[i] || ' ' || {words}[i + 1] "
            f"FOR i IN range(1, len({words}))])")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---------------------------------------------------------------- tokens

@query("tokenise_ws", f"""
SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, chr(1))) AS digest
FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)""")
def tokenise_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document and a digest over all its tokens."""
    t = documents(spark, sf_dir).select("doc_id", whitespace_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"),
                    F.md5(F.array_join("t", "\x01")).alias("digest"))


@query("tokenise_word", f"""
SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, chr(1))) AS digest
FROM (SELECT doc_id, {words_sql('text')} AS t FROM documents)""")
def tokenise_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"),
                    F.md5(F.array_join("t", "\x01")).alias("digest"))


@query("ngrams12", f"""
SELECT doc_id, len(g) AS grams, md5(array_to_string(g, chr(1))) AS digest
FROM (SELECT doc_id, {grams_sql('w')} AS g
      FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents))""")
def ngrams12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", word_tokens(F.col("text")).alias("w"))
    g = words.select("doc_id", with_bigrams(F.col("w")).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("grams"),
                    F.md5(F.array_join("g", "\x01")).alias("digest"))


# ---------------------------------------------------------------- BM25

LENGTHS = f"""lens AS (SELECT doc_id, t, len(t) AS dl FROM (
  SELECT doc_id, {tokens_sql('text')} AS t FROM documents))"""
POSTINGS = """toks AS (SELECT doc_id, dl, unnest(t) AS term FROM lens),
postings AS (SELECT doc_id, dl, term, count(*) AS tf FROM toks GROUP BY doc_id, dl, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avg_dl FROM lens),
idfs AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM dfs, size)"""
MATCHES = f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (
    SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark)
  GROUP BY query_id, term),
matches AS (SELECT query_id, doc_id, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))))
              AS bm25
  FROM qt JOIN postings USING (term) JOIN idfs USING (term), size GROUP BY query_id, doc_id)"""


@query("bm25_index", with_ctes(LENGTHS, POSTINGS, body="""
SELECT term, df, round(idf, 6) AS idf FROM idfs"""))
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_index(documents(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("bm25_scores", with_ctes(LENGTHS, POSTINGS, MATCHES, body="""
SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM matches
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) = 1"""))
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best document of the whole corpus for every benchmark text."""
    matches = R.bm25_matches(questions(spark, sf_dir), documents(spark, sf_dir))
    return R.best_match(matches, "bm25")


@query("minmax_norm", with_ctes(LENGTHS, POSTINGS, MATCHES, body="""
, normed AS (SELECT query_id, doc_id, bm25, max(bm25) OVER q - min(bm25) OVER q AS w,
         min(bm25) OVER q AS lo FROM matches WINDOW q AS (PARTITION BY query_id))
SELECT query_id, count(*) AS docs,
       round(avg(CASE WHEN w < 1e-10 THEN 0.5 ELSE (bm25 - lo) / w END), 6) AS mean_norm
FROM normed GROUP BY query_id"""))
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the matching documents scaled to [0, 1] per query, then summarised.

    The mean of scaled scores is the scaled mean, so no pair is kept.
    """
    matches = R.bm25_matches(questions(spark, sf_dir), documents(spark, sf_dir))
    ends = matches.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("docs"), F.min("bm25").alias("lo"), F.max("bm25").alias("hi"),
        F.avg("bm25").alias("mean"))
    width = F.col("hi") - F.col("lo")
    norm = F.when(width < 1e-10, 0.5).otherwise((F.col("mean") - F.col("lo")) / width)
    return ends.select("query_id", "docs", F.round(norm, 6).alias("mean_norm"))


# ---------------------------------------------------------------- TF-IDF and latent vectors

GRAMS = f"""grams AS (SELECT doc_id, unnest(g) AS term FROM (
  SELECT doc_id, {grams_sql('w')} AS g FROM (
    SELECT doc_id, {words_sql('text')} AS w FROM documents))),
vocab AS (SELECT term, count(*) AS total FROM grams GROUP BY term
          ORDER BY total DESC, term LIMIT {fv.VOCABULARY_LIMIT})"""


@query("vocab_topk", with_ctes(GRAMS, body="SELECT term, total FROM vocab"))
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vocabulary(documents(spark, sf_dir))


@query("tfidf", with_ctes(GRAMS, """counts AS (
  SELECT doc_id, term, count(*) AS tf FROM grams WHERE term IN (SELECT term FROM vocab)
  GROUP BY doc_id, term),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf
        FROM counts GROUP BY term),
raw AS (SELECT doc_id, term, tf, (1.0 + ln(tf)) * idf AS w FROM counts JOIN idf USING (term))""",
                          body="""
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM raw"""))
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stage(R.split_words(documents(spark, sf_dir)), "words")
    terms = stage(R.vocabulary_of(words), "vocabulary")
    return R.tfidf(words, terms).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query("lsa_embed")
def lsa_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent vector of every document; signs of components are not determined."""
    docs = documents(spark, sf_dir)
    model = R.fit_latent(docs)
    return R.latent_embedding(docs, model).select(
        "doc_id", *[F.col("v")[i].alias(f"c{i}") for i in range(model.rank)])


# ---------------------------------------------------------------- dense vectors

@query("l2_normalise", """
WITH n AS (SELECT vec_id, embedding AS e,
                  sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS n
           FROM embeddings)
SELECT vec_id, round(sqrt(list_sum([(x / n) * (x / n) FOR x IN e])), 6) AS length,
       round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last FROM n""")
def l2_normalise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.functions.vectors import norm
    u = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalise(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(norm(F.col("u")), 6).alias("length"),
                    F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


CENTROIDS = """dims AS (SELECT vec_id, label, unnest(range(64)) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cents AS (SELECT label, i, avg(x) AS c FROM dims GROUP BY label, i),
cos AS (SELECT d.vec_id, c.label, sum(d.x * c.c) / (sqrt(sum(d.x * d.x)) * sqrt(sum(c.c * c.c)))
          AS cosine
  FROM dims d JOIN cents c USING (i) GROUP BY d.vec_id, c.label)"""


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label: element-wise averages keep one row per label."""
    long = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    cells = F.sort_array(F.collect_list(F.struct("i", "c")))
    return mean.groupBy("label").agg(F.transform(cells, lambda s: s["c"]).alias("v"))


def _vectors_and_centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return queries, stage(centroids(vectors), "centroids")


def centroid_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cosine_to_catalogue(*_vectors_and_centroids(spark, sf_dir))


@query("cosine_scores", with_ctes(CENTROIDS, body="""
SELECT vec_id, label, round(cosine, 6) AS cosine FROM cos"""))
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the ten label centroids."""
    return centroid_cosines(spark, sf_dir).select(
        F.col("query_id").alias("vec_id"), "label", F.round("cosine", 6).alias("cosine"))


@query("retrieve_top1", with_ctes(CENTROIDS, body="""
SELECT vec_id, label, round(cosine, 6) AS cosine FROM cos
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 6) DESC, label) = 1"""))
def retrieve_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest centroid of every vector, the lowest label on ties."""
    best = R.nearest_in_catalogue(*_vectors_and_centroids(spark, sf_dir))
    return best.withColumnRenamed("query_id", "vec_id")


@query("hybrid_blend", with_ctes(CENTROIDS, """bm AS (
  SELECT vec_id, label, CAST((vec_id * 31 + label * 17) % 13 AS DOUBLE) AS b FROM cos),
normed AS (SELECT c.vec_id, c.label,
    CASE WHEN max(cosine) OVER q - min(cosine) OVER q < 1e-10 THEN 0.5
         ELSE (cosine - min(cosine) OVER q) / (max(cosine) OVER q - min(cosine) OVER q) END AS l,
    CASE WHEN max(b) OVER q - min(b) OVER q < 1e-10 THEN 0.5
         ELSE (b - min(b) OVER q) / (max(b) OVER q - min(b) OVER q) END AS b
  FROM cos c JOIN bm USING (vec_id, label) WINDOW q AS (PARTITION BY c.vec_id))""", body="""
SELECT vec_id, label, round(CAST(0.55 AS DOUBLE) * l + CAST(0.45 AS DOUBLE) * b, 5) AS hybrid FROM normed"""))
def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both normalised scores blended; the lexical one is made from the ids."""
    scored = stage(centroid_cosines(spark, sf_dir).withColumn(
        "b", ((F.col("query_id") * 31 + F.col("label") * 17) % 13).cast("double")), "cosines")
    both = R.min_max_by(R.min_max_by(scored, ["query_id"], "cosine", "l"), ["query_id"], "b", "bn")
    return both.select(F.col("query_id").alias("vec_id"), "label", F.round(
        F.lit(fv.LSA_WEIGHT) * F.col("l") + F.lit(fv.BM25_WEIGHT) * F.col("bn"), 5).alias("hybrid"))


# ---------------------------------------------------------------- explanation and retrieval

def saliency_sql(n: int) -> str:
    union = " UNION ALL ".join(
        f"SELECT day, split, seq, y, p, l_suppkey, {i} AS idx, '{f}' AS name, "
        f"round(p * (1.0 - p) * s_{f}, {explain.SALIENCY_DIGITS}) AS importance FROM scored" for i, f in enumerate(FLOW_FEATURES))
    return f"""sal AS ({union}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day, split, seq
                                         ORDER BY importance DESC, idx DESC) AS rn FROM sal),
top AS (SELECT * FROM ranked WHERE rn <= {n})"""


SALIENT = (*WINDOWED, PARAMS, SCALES, SCALED, model_sql())


@query("saliency_logistic", with_ctes(*SALIENT, saliency_sql(4), body="""
SELECT day, split, seq, name, round(importance, 6) AS importance FROM sal"""))
def saliency_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_flows(spark, sf_dir)
    return scored.select(*KEY, F.explode("saliency").alias("s")).select(
        *KEY, "s.name", F.round("s.importance", 6).alias("importance"))


@query("topn_importance", with_ctes(*SALIENT, saliency_sql(3), body="""
SELECT day, split, seq, name,
       round(importance / sum(importance) OVER (PARTITION BY day, split, seq), 6) AS importance
FROM top"""))
def topn_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scored_flows(spark, sf_dir).select(
        *KEY, F.explode(explain.top_importances(F.col("saliency"), 3)).alias("s"))
    return top.select(*KEY, "s.name", F.round("s.importance", 6).alias("importance"))


@query("explain_query_text", with_ctes(*SALIENT, saliency_sql(3), body="""
SELECT day, split, seq, replace(lower(string_agg(name, ' ' ORDER BY rn)), '_', ' ') AS query
FROM top GROUP BY day, split, seq"""))
def explain_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = explain.top_importances(F.col("saliency"), 3)
    return scored_flows(spark, sf_dir).select(
        *KEY, explain_query(F.transform(top, lambda s: s["name"])).alias("query"))


@query("feature_name_pad", with_ctes(*WINDOWED, body="""
, m AS (SELECT day, split, seq, [avg(flow_duration), avg(flow_bytes), avg(packet_length),
                                 avg(syn_flag_count)] AS a FROM win GROUP BY day, split, seq),
l AS (SELECT day, split, seq, unnest([0, 1, 2, 3]) AS idx, unnest(a) AS v FROM m)
SELECT day, split, seq, idx, CASE idx WHEN 0 THEN 'flow_duration' WHEN 1 THEN 'flow_bytes'
       ELSE 'F' || idx END AS name, round(v, 4) AS importance FROM l"""))
def feature_name_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional values joined with a name list that is too short."""
    from flowlens.operators.windows import window_rows
    from flowlens.sources.tables import FLOW_TIES, flows
    means = window_rows(flows(spark, sf_dir), FLOW_TIES).groupBy(*KEY).agg(
        F.array(*[F.round(F.avg(f), 4) for f in FLOW_FEATURES]).alias("importance"))
    names = spark.createDataFrame(list(enumerate(FLOW_FEATURES[:2])), "idx int, name string")
    return explain.name_importances(means, KEY, names)


def catalogue_values() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(q(v) for v in t[:5])}, [{', '.join(q(r) for r in t[5])}], "
                     f"{q(t[6])})" for i, t in enumerate(fv.THREATS))
    return ("kb AS (SELECT * FROM (VALUES " + rows + ") k(idx, threat_id, title, tactic, keywords, "
            "playbook, iptables, indicators))")


def bm25_catalogue_sql(queries: str) -> str:
    """BM25 retrieval of ``queries(query_id, text)`` against the catalogue, as SQL."""
    return f"""kt AS (SELECT idx, {tokens_sql("title || ' ' || keywords || ' ' || playbook")} AS t
  FROM kb),
kp AS (SELECT idx, dl, term, count(*) AS tf FROM (SELECT idx, len(t) AS dl, unnest(t) AS term FROM kt)
  GROUP BY idx, dl, term),
kd AS (SELECT term, count(*) AS df FROM kp GROUP BY term),
ks AS (SELECT avg(len(t)) AS a FROM kt),
kw AS (SELECT idx, kp.term, ln((6.0 - df + 0.5) / (df + 0.5) + 1.0)
              * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS w
  FROM kp JOIN kd USING (term), ks),
qtok AS (SELECT query_id, unnest({tokens_sql('text')}) AS term FROM {queries}),
part AS (SELECT query_id, idx, sum(w) AS s FROM qtok JOIN kw USING (term) GROUP BY query_id, idx),
grid AS (SELECT q.query_id, kb.idx, coalesce(s, 0.0) AS s
  FROM {queries} q CROSS JOIN kb LEFT JOIN part USING (query_id, idx)),
nrm AS (SELECT query_id, idx, s, CASE WHEN max(s) OVER q - min(s) OVER q < 1e-10 THEN 0.5
     ELSE round((s - min(s) OVER q) / (max(s) OVER q - min(s) OVER q), 6) END AS b,
     max(s) OVER q > 0 AS matched FROM grid WINDOW q AS (PARTITION BY query_id)),
hit AS (SELECT query_id, idx, b AS bm25_score, matched FROM nrm
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b DESC, idx) = 1)"""


@query("bm25_catalogue", with_ctes(
    catalogue_values(), "qs AS (SELECT doc_id AS query_id, text FROM documents)",
    bm25_catalogue_sql("qs"), body="""
SELECT query_id, kb.threat_id, bm25_score, matched FROM hit JOIN kb USING (idx)"""))
def bm25_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical half of the retrieval on whole document texts."""
    catalogue = threat_catalogue(spark)
    texts = catalogue_text(catalogue)
    found = R.bm25_best(documents(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), texts)
    return found.withColumnRenamed("doc_id", "idx").join(F.broadcast(catalogue), "idx").select(
        "query_id", "threat_id", "bm25_score", "matched")


def hybrid_of(queries: str) -> tuple[str, ...]:
    """CTEs of the blended retrieval of ``queries(query_id, text)`` from the catalogue, ending in ``hyb``."""
    return (catalogue_values(), bm25_catalogue_sql(queries), hybrid_sql(queries, words_sql("text"), grams_sql("w")))


BLENDED = """query_id, round(b, 5) AS bm25_score, round(l, 5) AS lsa_score, round(h, 5) AS hybrid_score, matched"""


def _blended(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 5) for c in ("bm25_score", "lsa_score", "hybrid_score")})


@query("hybrid_retrieve", with_ctes(
    "qs AS (SELECT doc_id AS query_id, text FROM documents)", *hybrid_of("qs"),
    body=f"SELECT CAST(idx AS BIGINT) AS doc_id, {BLENDED} FROM hyb"))
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text matched against the threat catalogue by the blended score."""
    index = R.build_hybrid_index(catalogue_text(threat_catalogue(spark)))
    texts = documents(spark, sf_dir).withColumnRenamed("doc_id", "query_id")
    return _blended(R.hybrid_retrieve(texts, index))


@query("hybrid_corpus")
def hybrid_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text matched against all documents by the blended score."""
    return _blended(R.hybrid_retrieve(questions(spark, sf_dir), R.build_hybrid_index(documents(spark, sf_dir))))


def _threats(spark: SparkSession, queries: DataFrame) -> DataFrame:
    catalogue = threat_catalogue(spark)
    index = R.build_hybrid_index(catalogue_text(catalogue))
    found = R.hybrid_retrieve(queries, index).withColumnRenamed("doc_id", "idx")
    return found.join(F.broadcast(catalogue), "idx").select("query_id", "threat_id", "title", "tactic")


@query("map_threat", with_ctes(
    "qs AS (SELECT item_id AS query_id, text FROM benchmark)", *hybrid_of("qs"),
    body="SELECT query_id, threat_id, title, tactic FROM hyb JOIN kb USING (idx)"))
def map_threat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same on the benchmark texts, projected to the threat."""
    return _threats(spark, questions(spark, sf_dir))


EXPLANATIONS = (*SALIENT, saliency_sql(3), """qs AS (
  SELECT DISTINCT text AS query_id, text FROM (
    SELECT day, split, seq, replace(lower(string_agg(name, ' ' ORDER BY rn)), '_', ' ') AS text FROM top GROUP BY day, split, seq))""")


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct explanation texts of all scored windows."""
    texts = explain.detection_texts(scored_flows(spark, sf_dir), 3, 0.0).select("query_id").distinct()
    return stage(texts.withColumn("text", F.col("query_id")), "explanations")


@query("hybrid_explained", with_ctes(*EXPLANATIONS, *hybrid_of("qs"), body=f"""
SELECT threat_id, {BLENDED} FROM hyb JOIN kb USING (idx)"""))
def hybrid_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every explanation text, which names features, matched by the blended score; both halves are real."""
    catalogue = threat_catalogue(spark)
    found = _blended(R.hybrid_retrieve(explanations(spark, sf_dir), R.build_hybrid_index(catalogue_text(catalogue))))
    return found.withColumnRenamed("doc_id", "idx").join(F.broadcast(catalogue.select("idx", "threat_id")), "idx").drop("idx")


@query("map_threat_explained", with_ctes(*EXPLANATIONS, *hybrid_of("qs"), body="""
SELECT query_id, threat_id, title, tactic FROM hyb JOIN kb USING (idx)"""))
def map_threat_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threats of the explanation texts."""
    return _threats(spark, explanations(spark, sf_dir))


@query("explain_incidents", with_ctes(*SALIENT, saliency_sql(3), """qt AS (
  SELECT day, split, seq, y, p, replace(lower(string_agg(name, ' ' ORDER BY rn)), '_', ' ') AS query
  FROM top GROUP BY day, split, seq, y, p)""", f"hits AS (SELECT * FROM qt WHERE p >= {fv.DETECT_THRESHOLD})",
                                     "qs AS (SELECT DISTINCT query AS query_id, query AS text FROM hits)", *hybrid_of("qs"), body="""
SELECT day, split, seq, y, round(p, 4) AS probability, query, threat_id, round(h, 4) AS hybrid_score, matched
FROM hits JOIN hyb ON hyb.query_id = hits.query JOIN kb USING (idx)"""))
def explain_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected windows with their top features, threat and blended score in one plan."""
    catalogue = threat_catalogue(spark)
    index = R.build_hybrid_index(catalogue_text(catalogue))
    found = explain.explain_detections(stage(scored_flows(spark, sf_dir), "scored"), index, catalogue)
    return found.select(*KEY, "y", F.round("p", 4).alias("probability"), "query", "threat_id",
                        F.round("hybrid_score", 4).alias("hybrid_score"), "matched")


EXPLAINED = (*SALIENT, saliency_sql(3), catalogue_values(), """qt AS (
  SELECT day, split, seq, replace(lower(string_agg(name, ' ' ORDER BY rn)), '_', ' ') AS text
  FROM top WHERE round(p, 6) >= 0.5 GROUP BY day, split, seq)""",
             "qs AS (SELECT DISTINCT text AS query_id, text FROM qt)", bm25_catalogue_sql("qs"),
             """found AS (SELECT day, split, seq, text AS query, kb.threat_id, bm25_score, matched
  FROM qt JOIN hit ON hit.query_id = qt.text JOIN kb USING (idx))""")


RESPONSES = (*SALIENT, saliency_sql(len(FLOW_FEATURES)), f"""qt AS (
  SELECT day, seq, p, replace(lower(string_agg(name, ' ' ORDER BY rn)), '_', ' ') AS query, string_agg(name, ',' ORDER BY rn) AS names,
         round(max(importance) / sum(importance), 5) AS top_share
  FROM top WHERE split = 'test' GROUP BY day, seq, p),
hits AS (SELECT *, row_number() OVER (ORDER BY day, seq) AS n FROM qt WHERE p >= {fv.DETECT_THRESHOLD * 10}),
qs AS (SELECT DISTINCT query AS query_id, query AS text FROM hits)""", *hybrid_of("qs"))


@query("detection_responses", with_ctes(*RESPONSES, body=f"""
SELECT day, seq, printf('INC-2026-NIDS-%05d', n) AS incident_id, CAST(NULL AS VARCHAR) AS verdict, round(p, 4) AS probability, threat_id,
       title, names, top_share, round(h, 4) AS hybrid_score,
       replace(array_to_string(iptables, chr(10)), '{{src_ip}}', '10.1.' || (day % 256) || '.' || (seq % 256)) AS rules
FROM hits JOIN hyb ON hyb.query_id = hits.query JOIN kb USING (idx)
UNION ALL
SELECT day, seq, NULL, 'BENIGN', round(p, 4), NULL, NULL, NULL, NULL, NULL, NULL FROM qt WHERE p < {fv.DETECT_THRESHOLD * 10}"""))
def detection_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to every test window, read back from their JSON: number, verdict, threat, features, score, rules."""
    catalogue = threat_catalogue(spark)
    octet = lambda c: F.pmod(F.col(c).cast("long"), F.lit(256)).cast("string")
    scored = scored_flows(spark, sf_dir).where("split = 'test'").withColumns({
        "ts": F.timestamp_seconds("seq"), "src_ip": F.concat(F.lit("10.1."), octet("day"), F.lit("."), octet("seq"))})
    answers = explain.detection_responses(stage(scored, "scored"), R.build_hybrid_index(catalogue_text(catalogue)), catalogue,
                                          "day", "ts", ["seq"], threshold=fv.DETECT_THRESHOLD * 10)
    r = F.from_json("response", "incident_id string, verdict string, detection struct<is_threat: boolean, probability: double>, "
                    "threat struct<id: string, title: string>, xai struct<top_features: array<struct<name: string, importance: double>>>, "
                    "rag struct<hybrid_score: double>, response struct<iptables: array<string>>")
    top = F.col("r.xai.top_features")
    return answers.select("day", "seq", r.alias("r")).select(
        "day", "seq", "r.incident_id", "r.verdict", F.col("r.detection.probability").alias("probability"),
        F.col("r.threat.id").alias("threat_id"), F.col("r.threat.title").alias("title"),
        F.array_join(F.transform(top, lambda s: s["name"]), ",").alias("names"),
        F.round(F.array_max(F.transform(top, lambda s: s["importance"])), 5).alias("top_share"),
        F.col("r.rag.hybrid_score").alias("hybrid_score"), F.array_join("r.response.iptables", "\n").alias("rules"))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = threat_catalogue(spark)
    texts = catalogue_text(catalogue)
    scored = scored_flows(spark, sf_dir).withColumn("p", F.round("p", 6))
    hits = stage(explain.detection_texts(scored, 3, 0.5).select(*KEY, "query_id"), "explained")
    distinct = hits.select("query_id").distinct().withColumn("text", F.col("query_id"))
    best = R.bm25_best(distinct, texts).withColumnRenamed("doc_id", "idx")
    best = best.join(F.broadcast(catalogue.select("idx", "threat_id")), "idx").drop("idx")
    return hits.join(broadcast_if_small(stage(best, "matched-texts")), "query_id").select(
        *KEY, F.col("query_id").alias("query"), "threat_id", "bm25_score", "matched")


@query("explained_threats", with_ctes(*EXPLAINED, body="SELECT * FROM found"))
def explained_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected windows, their explanation and the threat it matches by BM25."""
    return _explained(spark, sf_dir)


@query("detected_rollup", with_ctes(*EXPLAINED, body="""
, firsts AS (SELECT threat_id, bm25_score FROM found
  QUALIFY row_number() OVER (PARTITION BY threat_id ORDER BY day, split, seq) = 1)
SELECT threat_id, n AS occurrences, bm25_score AS score
FROM (SELECT threat_id, count(*) AS n FROM found GROUP BY threat_id) JOIN firsts USING (threat_id)"""))
def detected_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained detections per threat, with the score of the first one."""
    from flowlens.operators.incidents import threat_rollup
    found = _explained(spark, sf_dir).withColumnRenamed("bm25_score", "score")
    return threat_rollup(found, list(KEY), "score")
