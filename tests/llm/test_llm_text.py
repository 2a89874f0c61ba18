"""Main text, token counts, quality statistics and license scans against plain Python."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from flowlens.llm import html_text, license_scan, quality_rules, token_counts

from .helpers import awkward_rows, docs_of, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
        "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class=\"ad\">Buy now</div>"
        "{main}<aside>See also this</aside><div id='comments'><p>first post</p></div><form>Name<input></form>"
        "<div class=cookie-notice>We use cookies</div><footer>&copy; site</footer></body></html>")
ARTICLE = ("<article><h1>Head &amp; tail</h1><p>Some   <b>bold</b>\n words<p>and more &lt;text&gt;<br>after a break"
           "<ul><li>one item<li>two <a href=x>linked</a> items</ul><script>x()</script><p>The end.</article>")
EXPECTED = "Head & tail\nSome bold words\nand more <text>\nafter a break\none item\ntwo linked items\nThe end."


@pytest.fixture(scope="module")
def weights():
    counts = collections.Counter()
    for i in range(20):
        counts.update(html_text.label_counts(PAGE.replace("{main}", f"<article><h1>{prose(i, 5)}</h1><p>{prose(i, 40)}</p></article>")))
    return html_text.weights_of(counts)


@pytest.mark.parametrize("main", [ARTICLE, ARTICLE.replace("article", "main"), ARTICLE.replace("article", "div")])
def test_main_text_of_marked_and_unmarked_pages(weights, main):
    assert html_text.main_text(PAGE.replace("{main}", main), weights) == EXPECTED


def test_wrapper_classes_do_not_hide_the_article(weights):
    page = PAGE.replace("{main}", f"<div class='layout with-sidebar'>{ARTICLE}</div>")
    assert html_text.main_text(page, weights) == EXPECTED
    assert html_text.main_text("<aside><article><p>a teaser</p></article></aside><p>the text", weights) == "the text"


def test_main_text_of_broken_pages(weights):
    text = lambda page: html_text.main_text(page, weights)
    assert text(None) == text("") == text("<nav>only a menu</nav>") == ""
    assert text("plain words & no markup") == "plain words & no markup"
    assert text("<article><p>cut off in a <b>tag <a href=\"x") == "cut off in a tag <a href=\"x"
    assert text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert text("<article><p>left <!-- open comment") == "left"
    assert text("<article><p>" + "word " * 50_000) == " ".join(["word"] * 50_000)


def test_region_is_the_best_of_all():
    """The linear scan against all pairs of ends; of ties the first start, and the longest from there."""
    import random
    pick = random.Random(4)
    for _ in range(400):
        scores = [pick.choice((-3.0, -1.5, -1.0, 0.0, 1.0, 2.0)) for _ in range(12)]
        low, high = html_text.best_region(scores)
        best = max([0.0] + [sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13)])
        assert abs(sum(scores[low:high]) - best) < 1e-9 and (best > 0) == (high > low)


THREE = "<h2>The head of it</h2>" + "".join(f"<p>{prose(i, 25)}</p>" for i in range(3))
THREE_TEXT = "\n".join(["The head of it", *(" ".join(prose(i, 25).split()) for i in range(3))])
MENU = "<div><ul>" + "".join(f"<li><a href='/{i}'>page {i}</a></li>" for i in range(8)) + "</ul></div>"


@pytest.mark.parametrize("name", ["tag-x", "share-price", "search-results", "login-guide", "promo", "comment", "alert", "banner",
                                  "header-2", "post related-post", "elementor-widget", "legal-text"])
def test_a_class_does_not_empty_the_article(weights, name):
    page = PAGE.replace("{main}", f"<div class='{name}'>{THREE}</div>")
    assert html_text.main_text(page, weights) == THREE_TEXT
    bare = f"<body>{MENU}<div class='{name}'><form>Search <input></form>{THREE}</div><div>All rights reserved by us</div></body>"
    assert html_text.main_text(bare, weights) == THREE_TEXT


@pytest.mark.parametrize("name", ["comments", "related", "promo", "sidebar", "ad", "share"])
def test_the_same_classes_beside_an_article_are_noise(weights, name):
    box = f"<div class='{name}'><p>{prose(50, 30)}</p><p>{prose(51, 200)}</p></div>"
    for page in (f"<body>{THREE}{box}</body>", f"<body>{box}<div>{THREE}</div></body>", f"<body><div>{THREE}</div><section>{box}{box}</section>"):
        assert html_text.main_text(page, weights) == THREE_TEXT


def test_the_scan_cuts_menus_and_closing_lines_without_a_class(weights):
    assert html_text.main_text(f"<body>{MENU}<div>{THREE}</div><div>All rights reserved</div></body>", weights) == THREE_TEXT
    assert html_text.main_text(f"<body><div>{THREE}</div>{MENU}</body>", weights) == THREE_TEXT
    assert html_text.main_text(f"<article><header><h1>Top line</h1></header>{THREE}</article>", weights) == "Top line\n" + THREE_TEXT
    lines = [f"line {i} of a text in plain boxes" for i in range(9)]
    assert html_text.main_text("".join(f"<div>{x}</div>" for x in lines), weights) == "\n".join(lines)


def test_marked_articles_are_found_without_their_marks(spark, sf_dir):
    """Pages that weren't fitted, with article, ad class and nav and footer elements made plain boxes."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    pages = [r.html for r in spark.read.parquet(f"{big}/pages.parquet").collect()]
    fitted = collections.Counter()
    for page in pages[::2]:
        fitted.update(html_text.label_counts(page))
    own = html_text.weights_of(fitted)
    right = cut = 0
    for page in pages[1::2]:
        want = html_text.render([p for p in html_text.tokenize(page) if p.content and not p.noise])
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page.replace(' class="ad"', ""))
        right += html_text.main_text(bare, own) == want
        whole = html_text.render([p for p in html_text.tokenize(bare) if not p.noise])
        cut += whole != html_text.main_text(bare, own)
        assert html_text.main_text(page, own) == want
    assert right >= 0.9 * len(pages[1::2]) and cut == len(pages[1::2])


@pytest.mark.parametrize("noise", [
    "<div class=ad>{}</div>", "<aside><h2>{}</h2><ul><li>{}</li></ul></aside>", "<form><p>{}</p><input></form>",
    "<div class='related'><p>{}</p><div><p>{}</p></div></div>", "<nav><ol><li><a href=#a>{}</a></li></ol></nav>"])
@pytest.mark.parametrize("element", ["article", "div"])
def test_noise_inside_the_article_does_not_cut_it(weights, noise, element):
    inner = noise.replace("{}", prose(99, 400))
    page = PAGE.replace("{main}", f"<{element}><h1>A short head</h1>{inner}<p>The long middle of it.</p>{inner}<p>The end.</p></{element}>")
    assert html_text.main_text(page, weights) == "A short head\nThe long middle of it.\nThe end."
    assert html_text.main_text(f"<p>one{inner}two", weights) == "one\ntwo"


def test_pages_query_handles_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "http://a", PAGE.replace("{main}", ARTICLE)), (2, None, None), (None, "http://b", ""), (3, "http://c", "<p>x</p>"),
            (3, "http://c", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()}
    assert out[(1, "http://a")] == (EXPECTED, len(EXPECTED)) and out[(2, None)] == ("", 0) and out[(None, "http://b")] == ("", 0)
    assert html_text.extract_main_text(pages).count() == 5
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- token counts

def marked_pieces(word: str, vocabulary: set) -> int:
    """Greedy longest match over the word with its mark in front; the pieces keep theirs."""
    word, at, n = "▁" + word, 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary and "▁" not in word[max(at, 1):e]), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def public_vocabulary() -> set:
    """Read here, not by the operator."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.VOCABULARY)
    return {model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def test_token_counts_of_the_public_vocabulary(spark, sf_dir):
    vocabulary = public_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count_tokens(docs).collect():
        words = WORD.findall(texts[r.doc_id])
        n = [marked_pieces(w, vocabulary) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(x or 1 for x in n), sum(not x for x in n))


def test_bare_word_start_is_a_piece():
    import random
    pick = random.Random(8)
    for _ in range(120):
        piece = lambda: "".join(pick.choice("abc") for _ in range(pick.randrange(1, 5)))
        first, later = ([piece() for _ in range(pick.randrange(0, 9))] for _ in range(2))
        for bare in (["▁"], []):
            machine = token_counts.LongestMatch([*first, *("" for _ in bare)], later)
            for _ in range(60):
                word = "".join(pick.choice("abc") for _ in range(pick.randrange(1, 14)))
                assert machine.count(word) == marked_pieces(word, {*bare, *("▁" + x for x in first), *later}), (word, first, later)


def test_words_without_a_start_piece_are_cut(spark):
    vocabulary = public_vocabulary()
    words = ["ñandu", "中国人民", "the", "stone", "ñ", "Übermut", "x" * 300, "▁", "a▁b"]
    n = [marked_pieces(w, vocabulary) for w in words]
    assert n[0] == 4 and n[1] == 5
    out = token_counts.count_tokens(docs_of(spark, [(i, w, "en", "s", None) for i, w in enumerate(words)])).collect()
    assert {r.doc_id: (r.n_tokens, r.n_unknown) for r in out} == {i: (k or 1, int(not k)) for i, k in enumerate(n)}


def test_token_counts_of_awkward_rows(spark):
    docs = docs_of(spark, awkward_rows(), extra=True)
    out = token_counts.count_tokens(docs)
    assert out.count() == len(awkward_rows())
    by_id = {r.doc_id: r for r in out.collect()}
    assert tuple(by_id[100])[1:] == tuple(by_id[101])[1:] == tuple(by_id[102])[1:] == (0, 0, 0)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- quality statistics

def plain_statistics(text):
    words = WORD.findall(text or "")
    count = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def check_base(out, texts):
    for r in out:
        want = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_quality_statistics_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_base(quality_rules.apply_rules(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_quality_statistics_of_awkward_rows(spark):
    rows = awkward_rows() + [(300, "a b c a b c\na b c\n\na b c\n x y", "en", "s", None), (301, "w " * 9000, "en", "s", None),
                             (302, "é ß   z\x0bq\r\n\r\nq", "fr", "s", None)]
    rows = [r for r in rows if r[0] is not None]
    out = quality_rules.apply_rules(docs_of(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    check_base(out, {r[0]: r[1] for r in rows})
    assert quality_rules.apply_rules(docs_of(spark, rows).limit(0)).count() == 0


def test_rules_reject_outliers_and_keep_the_rest(spark):
    """A few documents of symbols or capitals among regular ones, per language and source."""
    rows = [(i, prose(i, 90 + i % 60), ("en", "de")[i % 2], f"s{i % 3}", None) for i in range(600)]
    odd = {7: lambda t: t.replace(" ", "### "), 8: lambda t: t.upper(), 9: lambda t: " | ".join(t.split())}
    rows = [(i, odd[i](t) if i in odd else t, *rest) for i, t, *rest in rows]
    docs = docs_of(spark, rows)
    kept = {r.doc_id for r in quality_rules.apply_rules(docs).where("kept").collect()}
    assert kept == {i for i, *_ in rows} - set(odd)
    stay = quality_rules.drop_outliers(docs_of(spark, rows, extra=True))
    assert {r.doc_id for r in stay.collect()} == kept and stay.columns == docs_of(spark, rows[:1], extra=True).columns


def test_distance_is_that_of_the_covariance(spark):
    """Inverse Cholesky factor by SQL against numpy, with the priors switched off by one group."""
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, quality_rules.P)) @ rng.normal(size=(quality_rules.P, quality_rules.P))
    rows = spark.createDataFrame([("l", "g", *map(float, r)) for r in x], "lang_key string, key string, " + ", ".join(
        f"x{i} double" for i in range(quality_rules.P)))
    params = quality_rules._whiten(quality_rules._shrunk(quality_rules._moments(rows)))
    got = sorted(r.d for r in quality_rules._at(rows, params).select("d").collect())
    cov = np.cov(x.T, bias=True) + np.diag([f ** 2 for f in quality_rules.FLOORS.values()])
    c = x - x.mean(axis=0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)), rtol=1e-6)


# ---------------------------------------------------------------- licenses

def plain_scan(rows, templates, containment=0.8):
    strip = lambda t: [w for w in ("".join(c for c in x if not re.match(r"[!-/:-@\[-`{-~]", c))
                                   for x in WORD.findall((t or "").lower())) if w]
    runs = lambda w: [" ".join(w[i:i + 5]) for i in range(len(w) - 4)]
    out = set()
    for i, text in rows:
        own = runs(strip(text))
        for k, (name, body) in enumerate(templates):
            want = set(runs(strip(body)))
            m = len(want)
            size = m + license_scan.window_step(m) - 1
            best = max((len(want & set(own[s:s + size])) / m for s in range(max(1, len(own)))), default=0)
            if best >= containment:
                out.add((i, name, k))
    return out


def test_licenses_are_found_like_by_brute_force(spark):
    gpl, mit = license_scan.TEMPLATES[7][1], license_scan.TEMPLATES[5][1]
    rows = [(1, prose(1, 60) + "\n" + gpl + "\n" + prose(2, 40)), (2, mit.upper().replace(" ", "\n  ")), (3, prose(4, 300)),
            (4, gpl.replace("GNU", "XYZ")), (5, " ".join(gpl.split()[:20])), (6, None), (7, ""), (8, "Released under the MIT License."),
            (9, "x " * 8000 + "Licensed under CC BY-NC 4.0. " + "y " * 3000), (10, "released under the mit"),
            (None, "Released under the MIT License!"), (8, "Released under the MIT License.")]
    rows += [(100 + i, prose(i, 80) + " " + license_scan.TEMPLATES[i][1] + " " + prose(i + 50, 50))
             for i in range(len(license_scan.TEMPLATES))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("words", F.lit(1))
    templates = license_scan.load_templates(spark)
    out = license_scan.scan_licenses(docs, templates).collect()
    # of templates that overlap one is told, and every place that holds any tells one
    every = plain_scan(rows, license_scan.TEMPLATES)
    told = {(r.doc_id, r.license, r.template) for r in out}
    assert told <= every and {i for i, *_ in told} == {i for i, *_ in every}
    licenses = lambda i: {name for k, name, _ in told if k == i}
    assert licenses(1) == {"GPL-3.0"} and licenses(2) == licenses(8) == licenses(None) == {"MIT"} and licenses(9) == {"CC-BY-NC-4.0"}
    for i, (name, _) in enumerate(license_scan.TEMPLATES):
        assert licenses(100 + i) == {name}, name
    assert sum(r.doc_id == 8 for r in out) == 2  # repeated rows have results each
    start = next(r for r in out if r.doc_id == 9)
    assert (start.start_word, start.containment) == (8000, 1.0)
    assert license_scan.scan_licenses(docs.limit(0), templates).count() == 0


def test_related_licenses_are_told_apart(spark):
    """Notices as projects write them, and two in one text."""
    lesser = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
              "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
              "version. This library is distributed in the hope that it will be useful")
    affero = ("Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
              "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    two = license_scan.TEMPLATES[8][1] + " " + prose(5, 90) + " " + license_scan.TEMPLATES[7][1]
    clauses = "\n".join(body for name, body in license_scan.TEMPLATES if name.startswith("BSD"))
    docs = docs_of(spark, [(1, lesser, "en", "s", 1), (2, affero, "en", "s", 1), (3, two, "en", "s", 1), (4, clauses, "en", "s", 1)], extra=True)
    out = collections.defaultdict(list)
    for r in license_scan.scan_licenses(docs, license_scan.load_templates(spark)).collect():
        out[r.doc_id].append(r.license)
    assert out[1] == ["LGPL-2.1"] and out[2] == ["AGPL-3.0"] and sorted(out[3]) == ["GPL-2.0", "GPL-3.0"]
    assert sorted(out[4]) == ["BSD", "BSD-2-Clause", "BSD-3-Clause"]


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.load_templates(spark, (("X", "too short"),))
