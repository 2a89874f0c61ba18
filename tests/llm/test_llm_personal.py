"""Personal data: patterns against their regular expressions, the field against enumeration, held-out sentences."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from flowlens.llm import personal_data as pd
from flowlens.llm.personal_table import HELD_OUT, plain_lines

from .helpers import awkward_rows, docs_of


@pytest.fixture(scope="module")
def field():
    return pd.train()


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain_patterns(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or
                    kind == "card" and not (12 <= len(digits) <= 19 and plain_luhn(digits)) or
                    kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), pd.KINDS.index(kind), m.end()))
    return sorted(out)


def test_patterns_equal_their_expressions():
    pick = random.Random(5)
    pieces = ["a", "b.c", "@", "x@y.z", "mail", ".", "-", "+", " ", "\n", "_", "%", "1", "12", "255", "256", "003", "1.2.3.4", "10.0.0.256",
              "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (212) 555-0198", "(", ")", "é", "\U0001f600", "٣", "0"]
    for _ in range(6000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randrange(14)))
        assert pd.pattern_spans(text) == plain_patterns(text), text


def test_patterns_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1." * 200_000, "+1" * 100_000, "1 " * 200_000, "a.b@c" * 80_000):
        assert pd.pattern_spans(text) is not None


def test_tokens_cover_what_is_no_space():
    for text in ("", " \n\t", "Ab1 c-d\n\nÉtéあx\U0001f600!", *plain_lines(3, 5).split("\n")):
        t = pd.tokens_of(text)
        assert "".join(text[a:b] for a, b in zip(t.start, t.end)) == re.sub(r"\s", "", text)
        assert [text[:a].count("\n") for a in t.start] == t.line.tolist()


def small_field(seed, tags=len(pd.TAGS)):
    draw = np.random.default_rng(seed)
    words = pd.known_words(["mr", "telefon", "nombre"])
    out = pd.Field(words, draw.normal(size=(len(pd.AROUND), pd.FIRST_WORD + 3, tags)), draw.normal(size=(2, 2, tags)),
                   draw.normal(size=(tags, tags)), draw.normal(size=tags), draw.normal(size=tags))
    out.move[pd._FORBIDDEN_MOVES] = pd.FORBIDDEN
    out.first[pd._FORBIDDEN_FIRST] = pd.FORBIDDEN
    return out


def path_score(field, scores, path):
    return (field.first[path[0]] + field.last[path[-1]] + sum(scores[i][y] for i, y in enumerate(path))
            + sum(field.move[a, b] for a, b in zip(path, path[1:])))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("lead", [0.0, 3.0, 6.0])
def test_decoding_equals_enumeration(seed, lead):
    field = small_field(seed)
    field.emit[2, :, 0] += lead  # the larger, the fewer tokens may leave O
    t = pd.tokens_of("Mr X 12\nTelefon 3\n\nnombre, a B c\n9\nx y Z w")
    lines = pd.lines_of(t, field.types(t))
    scores = pd.emissions(field, lines, np.arange(len(t.start)))
    tags = pd.decode(field, lines, scores)
    for low, high in zip(lines.bounds, lines.bounds[1:]):
        own = scores[low:high]
        best = max(path_score(field, own, p) for p in itertools.product(range(len(pd.TAGS)), repeat=int(high - low)))
        assert path_score(field, own, tags[low:high].tolist()) == pytest.approx(best)


def test_likelihood_and_gradient():
    field = small_field(9)
    t = pd.tokens_of("Mr X 12\nTelefon 3\nab")
    lines, tags = pd.lines_of(t, field.types(t)), np.array([0, 7, 8, 0, 5, 0])
    near = [pd.sparse_sum(lines.types[lines.place + a], field.emit.shape[1]) for a in pd.AROUND]
    loss, grad = pd.objective(field, lines, tags, 0.0, near)
    scores = pd.emissions(field, lines, np.arange(6))
    want = 0.0
    for low, high in zip(lines.bounds, lines.bounds[1:]):
        own = scores[low:high]
        paths = [path_score(field, own, p) for p in itertools.product(range(len(pd.TAGS)), repeat=int(high - low))]
        want += np.log(np.exp(paths).sum()) - path_score(field, own, tags[low:high].tolist())
    assert loss == pytest.approx(want)
    draw = np.random.default_rng(1)
    for name in ("emit", "gaps", "move", "first", "last"):
        weights, slope = getattr(field, name).reshape(-1), getattr(grad, name).reshape(-1)
        used = np.flatnonzero(weights > pd.FORBIDDEN)
        for i in np.append(draw.choice(used, 8), used[np.argsort(-np.abs(slope[used]))[:4]]):
            was = weights[i]
            weights[i] = was + 1e-5
            up = pd.objective(field, lines, tags, 0.0, near)[0]
            weights[i] = was - 1e-5
            down = pd.objective(field, lines, tags, 0.0, near)[0]
            weights[i] = was
            assert slope[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_held_out_sentences(field):
    for text, spans in pd.marked(HELD_OUT):
        assert [(pd.KINDS[k], a, b) for a, k, b in pd.learnt_spans(field, text)] == spans, text
    assert pd.learnt_spans(field, plain_lines(77, 150)) == []


def test_clean_documents_get_no_more_spans(spark, sf_dir, field):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    assert sum(len(added) for _, added in pd.find_all(field, [r.text or "" for r in rows])) == 0


def test_parts_of_long_texts(field):
    line = "The river was quiet. My name is Anna Miller and I live here.\n"
    text = line * 3000 + "x" * 200_000 + " " + "word " * 30_000
    parts = pd.parts_of(text, 1 << 12)
    assert "".join(p for _, p in parts) == text and all(text[a:a + len(p)] == p and len(p) <= 1 << 12 for a, p in parts)
    (base, added), = pd.find_all(field, [text])
    assert base == [] and [text[a:b] for a, _, b in added] == ["Anna Miller"] * 3000


def test_added_spans_leave_those_of_patterns(field):
    text = "Phone: +1 (212) 555-0198, card: 4111 1111 1111 1111. My name is Anna Miller."
    (base, added), = pd.find_all(field, [text])
    assert base == plain_patterns(text) and [text[a:b] for a, _, b in added] == ["Anna Miller"]


def test_personal_data_of_awkward_rows(spark, field):
    extra = "mail a.b@c.de or 10.0.0.1; \xe9 +49 30 1234567, 4111 1111 1111 1111"
    rows = awkward_rows() + [(300, extra, "en", "s", None), (300, extra, "en", "s", None), (301, "Name: Peter Clark", "en", "s", None)]
    docs = docs_of(spark, rows, extra=True)
    out = pd.find_personal_data(docs, field).collect()
    want = []
    for i, text, *_ in rows:
        base = plain_patterns(text or "")
        joined = ",".join(f"{pd.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(k == kind for _, kind, _ in base) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined))
    got = [tuple(r)[:7] for r in out]
    named = [(r[0], *r[1:6], "") if r[0] == 301 else r for r in got]
    assert sorted(named, key=repr) == sorted(want, key=repr)
    assert [r.spans for r in out if r.doc_id == 301] == ["person:6:17"]
    assert pd.find_personal_data(docs.limit(0), field).collect() == []
