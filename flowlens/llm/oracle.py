"""DuckDB SQL for the queries that SQL can express: all windows, none passed over by a fingerprint."""

from __future__ import annotations

from flowlens.llm.license_scan import CONTAINMENT, TEMPLATES
from flowlens.llm.decontaminate import SIMILARITY

PUNCTUATION = "[!-/:-@\\[-`{-~]+"


def _words(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), '{PUNCTUATION}', '', 'g')"
    return f"[x for x in string_split_regex({plain}, '[\\x20\\x09-\\x0D]+') if x <> '']"


def license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(body)})" for i, (name, body) in enumerate(TEMPLATES))
    return f"""
WITH t(template, license, body) AS (VALUES {rows}),
tw AS (SELECT template, license, {_words('body')} AS w FROM t),
ts AS (SELECT DISTINCT template, license, array_to_string(w[i:i + 4], ' ') AS s
       FROM tw, unnest(range(1, len(w) - 3)) r(i)),
tm AS (SELECT template, count(*) AS m, greatest(1, count(*) // 4) AS step FROM ts GROUP BY template),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) r(i)),
hit AS (SELECT doc_id, template, license, m, step, pos, s FROM ds JOIN ts USING (s) JOIN tm USING (template)),
win AS (SELECT doc_id, template, license, m, k, count(DISTINCT s) AS c, min(pos) AS start_word
        FROM hit, unnest(range(greatest(0, pos - m + 1) // step, pos // step + 1)) r(k) GROUP BY ALL),
best AS (SELECT *, CAST(c AS DOUBLE) / m AS share FROM win WHERE CAST(c AS DOUBLE) / m >= {CONTAINMENT}
         QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY c DESC, start_word) = 1)
SELECT doc_id, license, CAST(template AS INTEGER) AS template, share AS containment, CAST(start_word AS INTEGER) AS start_word
FROM best a WHERE NOT EXISTS (
  SELECT 1 FROM best b WHERE b.doc_id = a.doc_id AND b.start_word < a.start_word + a.m + 4 AND a.start_word < b.start_word + b.m + 4
  AND (b.share > a.share OR b.share = a.share AND (b.m > a.m OR b.m = a.m AND b.template < a.template)))"""


def leaks_sql() -> str:
    return f"""
WITH iw AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS width FROM iw WHERE len(w) > 0),
its AS (SELECT item_id, n, width, array_to_string(w[i:i + width - 1], ' ') AS s, count(*) AS c
        FROM items, unnest(range(1, n - width + 2)) r(i) GROUP BY ALL),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
ds AS (SELECT doc_id, len(w) AS words, width, i - 1 AS pos, array_to_string(w[i:i + width - 1], ' ') AS s
       FROM d, (SELECT DISTINCT width FROM items), unnest(range(1, len(w) - width + 2)) r(i)),
hit AS (SELECT doc_id, words, item_id, n, n - width + 1 AS m, pos, s, c FROM ds JOIN its USING (width, s)),
cells AS (SELECT doc_id, item_id, n, m, start, s, least(count(*), any_value(c)) AS c
          FROM hit, unnest(range(greatest(0, pos - m + 1), least(pos, words - n) + 1)) r(start) GROUP BY doc_id, item_id, n, m, start, s),
win AS (SELECT doc_id, item_id, n, start, CAST(sum(c) AS DOUBLE) / (2 * m - sum(c)) AS similarity
        FROM cells GROUP BY doc_id, item_id, n, m, start)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words
FROM win WHERE similarity >= {SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


def hard_negatives_sql() -> str:
    return """
WITH c AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM c a JOIN c b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
    SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (
        PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
WHERE rank <= 5"""


def collocations_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
               translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x for x in string_split_regex(piece, '[\\x20\\x09]+') if x <> ''] AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
      FROM w, unnest(range(1, 6)) q(m), unnest(range(1, len(w) - m + 2)) r(i) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n,
               (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
        FROM c CROSS JOIN unnest(range(1, c.m)) q(k) JOIN n ON n.lang = c.lang
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c b ON s.lang = b.lang AND s.m < b.m AND 100 * b.a >= 100 * s.a
           AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM best ANTI JOIN inside USING (lang, phrase)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000"""
