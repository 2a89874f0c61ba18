"""Collocations against plain counting of all phrases."""

import collections
import re

import pytest

from flowlens.llm import collocations

from .helpers import awkward_rows, docs_of, rows_of
from .test_llm_corpus import lower


def plain_collocations(rows, least, longest, top):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        inside = any(lang == other and len(v) > len(w) and b >= a and any(v[i:i + len(w)] == w for i in range(len(v)))
                     for (other, v), b in f.items())
        if not inside:
            score, k, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                 for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
                   for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])), key=repr)


@pytest.mark.parametrize("chunk_tokens", [50, 1 << 20])
def test_phrases_of_awkward_rows(spark, chunk_tokens, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 20_000)
    rows = awkward_rows() + [
        (300 + i, t, lang, "s", None) for i in range(12) for lang in ("en", None, "x'\n") for t in
        ("New  York City is new york CITY; new york\tcity", "a a a a a a a. a a", "\xc4pfel und \xc4pfel\x0bund  birnen und \U0001f600 !",
         "an an an of, of an an\x1cof of an", ".,;", "")]
    out = collocations.mine_collocations(docs_of(spark, rows, extra=True), least=12, top=40, chunk_tokens=chunk_tokens)
    want = plain_collocations(rows, 12, 5, 40)
    assert len(want) > 20 and rows_of(out) == want


def test_phrases_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    out = collocations.mine_collocations(docs, least=30, chunk_tokens=4000)
    want = plain_collocations(rows, 30, 5, 2000)
    assert len(want) > 20 and rows_of(out) == want


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine_collocations(docs_of(spark, [])).collect() == []
    assert collocations.mine_collocations(docs_of(spark, [(1, None, None, None, None)])).collect() == []


