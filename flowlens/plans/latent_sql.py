"""SQL of the blended retrieval: latent directions of the threat catalogue, taken from its dense SVD, as a table."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np

from flowlens import fixed_values as fv


def catalogue_texts() -> list[str]:
    return [f"{t[1]} {t[3]} {t[4]}" for t in fv.THREATS]


def _grams(text: str) -> list[str]:
    words = re.findall(r"\w+", text.lower())
    return words + [" ".join(pair) for pair in zip(words, words[1:])]


@lru_cache(1)
def catalogue_directions() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, idf, directions and document vectors, by numpy's SVD of the whole matrix."""
    counts = [Counter(_grams(t)) for t in catalogue_texts()]
    total = sum(counts, Counter())
    terms = sorted(sorted(total, key=lambda t: (-total[t], t))[:fv.VOCABULARY_LIMIT])
    idf = np.array([np.log((1 + len(counts)) / (1 + sum(t in c for c in counts))) + 1 for t in terms])
    x = np.array([[(1 + np.log(c[t])) if c[t] else 0.0 for t in terms] for c in counts]) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = max(min(fv.LSA_COMPONENTS, len(counts) - 1, len(terms) - 1), 1)
    v = np.linalg.svd(x, full_matrices=False)[2][:k].T
    docs = x @ v
    return terms, idf, v, docs / np.linalg.norm(docs, axis=1, keepdims=True)


def _cells(row) -> str:
    return ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in row)


def hybrid_sql(queries: str, words: str, grams: str) -> str:
    """CTEs from ``queries(query_id, text)`` and ``nrm(query_id, idx, s, b, matched)`` of BM25 to ``hyb``.

    ``words`` and ``grams`` are the SQL of word tokens of ``text`` and of the grams of ``w``.
    """
    terms, idf, v, docs = catalogue_directions()
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(t)}, {_cells([i, *row])})" for t, i, row in zip(terms, idf, v))
    names = [f"c{k}" for k in range(v.shape[1])]
    vectors = ", ".join(f"({d}, {_cells(row)})" for d, row in enumerate(docs))
    length = "sqrt(" + " + ".join(f"{c} * {c}" for c in names) + ")"
    dot = " + ".join(f"coalesce(u.{c}, 0) * d.{c}" for c in names)
    return f"""lt AS (SELECT * FROM (VALUES {table}) t(term, idf, {', '.join(names)})),
ld AS (SELECT * FROM (VALUES {vectors}) d(idx, {', '.join(names)})),
lw AS (SELECT query_id, {words} AS w FROM {queries}),
lc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({grams}) AS term FROM lw) GROUP BY query_id, term),
lv AS (SELECT query_id, {', '.join(f'sum((1 + ln(tf)) * idf * {c}) AS {c}' for c in names)} FROM lc JOIN lt USING (term) GROUP BY query_id),
lu AS (SELECT query_id, {', '.join(f'{c} / CASE WHEN {length} = 0 THEN 1 ELSE {length} END AS {c}' for c in names)} FROM lv),
cosine AS (SELECT q.query_id, d.idx, {dot} AS x FROM {queries} q CROSS JOIN ld d LEFT JOIN lu u USING (query_id)),
ln_ AS (SELECT query_id, idx, CASE WHEN max(x) OVER q - min(x) OVER q < 1e-10 THEN 0.5
    ELSE (x - min(x) OVER q) / (max(x) OVER q - min(x) OVER q) END AS l FROM cosine WINDOW q AS (PARTITION BY query_id)),
bn AS (SELECT query_id, idx, CASE WHEN max(s) OVER q - min(s) OVER q < 1e-10 THEN 0.5
    ELSE (s - min(s) OVER q) / (max(s) OVER q - min(s) OVER q) END AS b, matched FROM nrm WINDOW q AS (PARTITION BY query_id)),
hyb AS (SELECT query_id, idx, b, l, {fv.LSA_WEIGHT} * l + {fv.BM25_WEIGHT} * b AS h, matched FROM bn JOIN ln_ USING (query_id, idx)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(h, 9) DESC, idx) = 1)"""
