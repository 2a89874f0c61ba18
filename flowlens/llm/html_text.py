"""Main text of web pages by the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import small_batches, spread_rows

#: Pages of the fit; their token counts are all that leaves the workers.
SAMPLE_PAGES = 2000
#: Added to every count; the most that one feature of a word weighs, and what a tag takes off.
SMOOTH = 1.0
MOST, LEAST_TAG, MOST_TAG = 3.0, 0.01, 0.25
#: What a word of an unknown kind scores.
USUAL_WORD = 0.5
#: Blocks by their words, and by the share of these in links.
LENGTHS, LINK_SHARES = (20, 40, 80), (0.0, 0.34, 0.67)
#: An element whose class speaks of noise isn't noise if outside of it there are fewer words than this part of
#: its own, and no paragraph of so many.
REST_SHARE, PARAGRAPH = 0.15, 10
#: Where the best region holds less than this part of the words outside noise and links, all of these are content.
REGION_SHARE = 0.5

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no markup; the tokenizer reads on to the end tag.
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split())
#: Never content, wherever they stand.
SKIPPED = frozenset(
    "nav footer header aside form script style noscript template iframe object svg canvas button select option textarea "
    "input label menu dialog audio video map head title".split())
#: Words in class, id or role that speak of menus, notices, adverts, reader comments and the like; see ``settle``.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adbox|banners?|sponsor(?:ed|s)?|promo(?:tion)?s?|nav|navbar|"
    r"navigation|menus?|breadcrumbs?|header|masthead|footer|sidebars?|aside|widgets?|related|recommend(?:ed|ations)?|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|share|"
    r"sharing|social|comments?|commentlist|replies|disqus|respond|pagination|pager|complementary|contentinfo|search|"
    r"toolbar|skip|copyright|disclaimer|tags?|legal)(?:$|[\s_\d-])", re.I)
#: Whole class names and ids that no wrapper of an article has.
ALWAYS = re.compile(
    r"(?:ads?|adverts?|advertisements?|adsense|adbox|sponsor(?:ed|s)?|nav|navbar|navigation|menus?|breadcrumbs?|masthead|footer|"
    r"sidebars?|related|recommend(?:ed|ations)?|cookies?|cookie-notice|consent|gdpr|popups?|newsletter|subscribe|subscription|"
    r"signup|comments|commentlist|replies|disqus|respond|pagination|pager|complementary|contentinfo|copyright|disclaimer)", re.I)
#: A start of one of these ends an open element of the other kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: They end an open paragraph.
_ENDS_P = BLOCKS - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head", "option",
                    "optgroup", "legend", "title"}
#: Marks of the labelled pages: what stands in them is content.
CONTENT = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_BROKEN = re.compile(r"</?[A-Za-z][^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_WORD = re.compile(r"[^\x20\x09-\x0D\xa0]+")


@dataclass(slots=True)
class Part:
    """A run of text or a tag, with the context that decides its weight."""
    text: str | None
    kind: str
    block: bool
    noise: bool
    words: int = 0
    content: bool = False
    link: bool = False
    #: Enclosing elements whose class speaks of noise, and features of a run's block.
    doubts: tuple = ()
    features: tuple = ()


@dataclass(slots=True)
class Open:
    """An element that isn't closed yet."""
    name: str
    noise: bool
    content: bool
    doubts: tuple


def tokenize(page: str) -> list[Part]:
    """Text runs and tags of a page in order; comments and declarations are dropped.

    An element that isn't closed ends with its parent. A ``<`` that starts no tag is text.
    """
    parts: list[Part] = []
    stack: list[Open] = []
    at, n, elements = 0, len(page), 0
    outside = Open("", False, False, ())

    def text(raw: str) -> None:
        if not raw:
            return
        top = stack[-1] if stack else outside
        plain = html.unescape(raw)
        parts.append(Part(plain, f"w:{_context(stack)}", False, top.noise, len(_WORD.findall(plain)), top.content,
                          any(s.name == "a" for s in stack[-4:]), top.doubts))

    while at < n:
        low = page.find("<", at)
        if low < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, low) or _BROKEN.match(page, low)
        if not m:  # no tag, so text up to the next one
            nxt = page.find("<", low + 1)
            nxt = n if nxt < 0 else nxt
            text(page[at:nxt])
            at = nxt
            continue
        text(page[at:low])
        at = m.end()
        if m.re is _BROKEN:  # a quote that never ends
            slash, name, attrs = re.match(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", m.group(), re.S).groups()
        else:
            slash, name, attrs = m.groups()
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCKS
        if slash:
            own = outside
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    own = stack[i]
                    del stack[i:]
                    break
            parts.append(Part(None, f"t:{name}", block, own.noise, 0, own.content, False, own.doubts))
            continue
        for shut in CLOSES.get(name, ()):
            if stack and stack[-1].name == shut:
                stack.pop()
        if name in _ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name in BLOCKS:
                    break
        top = stack[-1] if stack else outside
        # the head of an article holds its headline
        own = Open(name, top.noise or name in SKIPPED and not (name == "header" and top.content) or bool(attrs) and bool(_HIDDEN.search(attrs)),
                   top.content, top.doubts)
        if name in CONTENT:  # a class of a wrapper doesn't make the article noise, an element such as nav does
            own.content, own.doubts = True, ()
        elif said := _said_of_noise(name, attrs):
            elements += 1
            own.noise = own.noise or said == "always"
            own.doubts = (*own.doubts, elements)
        parts.append(Part(None, f"t:{name}", block, own.noise, 0, own.content, False, own.doubts))
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(own)
    settle(parts)
    return parts


def settle(parts: list[Part]) -> None:
    """Decide which doubted elements are noise, and give the runs the features of their blocks.

    A class such as ``comment`` or ``promo`` tells noise beside an article, not the article itself: an element
    that leaves almost no words, and no paragraph, outside of itself is none.
    """
    words: Counter = Counter()
    everything, paragraphs = 0, []
    for block in blocks_of(parts):
        n = sum(p.words for p in block if not p.noise)
        if not n:
            continue
        doubts = block[0].doubts
        free = sum(p.words for p in block if not p.noise and not p.link)
        everything += free
        if n >= PARAGRAPH and block[0].kind.startswith("w:p"):
            paragraphs.append(set(doubts))
        for d in doubts:
            words[d] += free
    cleared = {d for d, n in words.items() if everything - n < REST_SHARE * n and all(d in inside for inside in paragraphs)}
    for p in parts:
        p.noise = p.noise or any(d not in cleared for d in p.doubts)
    for block in blocks_of(parts):
        n = sum(p.words for p in block)
        share = sum(p.words for p in block if p.link) / n if n else 0.0
        shape = (f"f:length{bisect_right(LENGTHS, n)}", f"f:links{bisect_left(LINK_SHARES, share)}")
        for p in block:
            p.features = shape


def blocks_of(parts: list[Part]):
    """Runs of text between tags of blocks."""
    held: list[Part] = []
    for p in parts:
        if p.text is not None:
            held.append(p)
        elif p.block and held:
            yield held
            held = []
    if held:
        yield held


def _said_of_noise(name: str, attrs: str) -> str:
    """Whether class, id or role speak of noise: ``always``, ``maybe`` or not at all."""
    said = ""
    if attrs and name not in ("html", "body", "article", "main"):
        for m in _ATTRIBUTE.finditer(attrs):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            if any(ALWAYS.fullmatch(x) for x in value.split()):
                return "always"
            said = said or ("maybe" if NOISE.search(value) else "")
    return said


def _context(stack: list) -> str:
    """The innermost block and whether a link is open."""
    block = next((s.name for s in reversed(stack) if s.name in BLOCKS), "")
    return block + ("+a" if any(s.name == "a" for s in stack[-4:]) else "")


def label_counts(page: str) -> Counter:
    """(kind, content) of the words, by kind and by features of their blocks, and of the tags of a marked page.

    Words of menus, adverts and the like teach what isn't content, wherever their elements can be known.
    """
    parts = tokenize(page)
    if not any(p.content for p in parts):
        return Counter()
    out: Counter = Counter()
    for p in parts:
        content = p.content and not p.noise
        if p.text is None:
            out[(p.kind, content)] += 1
        else:
            for kind in (p.kind, *p.features, "w:*"):
                out[(kind, content)] += p.words
    return out


def weights_of(counts: dict) -> dict[str, float]:
    """Log of how much likelier each kind is in content than outside, at most ``MOST`` to either side.

    Both sides weigh alike, however long the pages' articles are. Length only speaks for content: short blocks
    are found in every article. A tag never adds.
    """
    counts = Counter(counts)
    of = {c: max(counts.get(("w:*", c), 0), 1) for c in (True, False)}
    weights = {}
    for kind in {k for k, _ in counts} - {"w:*"}:
        if kind[0] == "t":
            yes, no = counts.get((kind, True), 0) + SMOOTH, counts.get((kind, False), 0) + SMOOTH
            weights[kind] = min(max(math.log(yes / no), -MOST_TAG), -LEAST_TAG)
        else:
            yes, no = ((counts.get((kind, c), 0) + SMOOTH) / (of[c] + 2 * SMOOTH) for c in (True, False))
            odds = min(max(math.log(yes / no), -MOST), MOST)
            weights[kind] = max(odds, 0.0) if kind.startswith("f:length") else odds
    return weights


def score_of(p: Part, weights: dict[str, float]) -> float:
    """Words score the sum of what their kind and their block's features weigh; tags take off."""
    if p.text is None:
        return weights.get(p.kind, -LEAST_TAG)
    return p.words * (USUAL_WORD + sum(weights.get(k, 0.0) for k in (p.kind, *p.features)))


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and one past the last of the contiguous run of the highest score, in one linear scan.

    Of equal runs the first, and of those the longest, is taken; none if no score is above zero.
    """
    best, low, high, start, total = 0.0, 0, 0, 0, 0.0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def render(parts: list[Part]) -> str:
    """Blocks in page order joined by a line feed, white space in a block one space; noise is left out."""
    blocks, now = [], []

    def close() -> None:
        block = " ".join("".join(now).split())
        if block:
            blocks.append(block)
        now.clear()

    for p in parts:
        if p.text is None:
            if p.block:
                close()
        elif not p.noise:
            now.append(p.text)
    close()
    return "\n".join(blocks)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The content region's text; a page without any has none.

    A page whose best region leaves out most of the words outside noise and links is unlike those that the
    weights come from; its region then is all between the first and the last block with such words.
    """
    if not page:
        return ""
    # noise is never rendered, so it may not part what stands before it from what stands after it
    parts = tokenize(page)
    scored = [i for i, p in enumerate(parts) if not p.noise]
    low, high = best_region([score_of(parts[i], weights) for i in scored])
    free = lambda some: sum(parts[i].words for i in some if not parts[i].link)
    if free(scored[low:high]) < REGION_SHARE * free(scored):
        plain = [k for k, i in enumerate(scored) if parts[i].words and not parts[i].link]
        low, high = plain[0], plain[-1] + 1
    return render(parts[scored[low]:scored[high - 1] + 1]) if low < high else ""


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from pages that mark their content by ``article`` or ``main``, about ``sample`` of them.

    Counts are summed in Spark; what comes to the driver is a row per kind of token, of which there
    are as many as names of elements.
    """
    n = pages.count()
    share = min(1.0, sample / n) if n else 1.0
    chosen = pages.select("html").where(F.col("html").isNotNull() & (
        F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20))))

    def count(batches):
        total: Counter = Counter()
        for batch in small_batches(batches):
            for page in batch.column(0).to_pylist():
                total.update(label_counts(page))
        rows = [(k if len(k) < 40 else k[:2] + "?", c, n) for (k, c), n in total.items()]
        if rows:
            kinds, content, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(content), pa.array(n, pa.int64())],
                                             names=["kind", "content", "n"])

    known = VOID | RAW | BLOCKS | SKIPPED | {"a", "b", "i", "em", "strong", "span", "u", "small", "code", "sup", "sub"}
    counted = chosen.mapInArrow(count, "kind string, content boolean, n bigint").where(
        F.regexp_extract("kind", r"^.:([a-z0-9]*)", 1).isin([*known, ""]) | F.col("kind").like("f:%") | (F.col("kind") == "w:*")).groupBy("kind", "content").agg(F.sum("n").alias("n"))
    return weights_of({(r.kind, r.content): r.n for r in counted.collect()})


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``, from the whole html.

    ``pages`` needs page_id, url and html; other columns are ignored. Without ``weights`` they are
    fitted on the pages themselves; if none marks its content, words score and tags take off the least.
    Null or empty html, and pages without content, give an empty text. Repeated rows stay.
    """
    weights = train(pages, sample) if weights is None else weights
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    narrow = spread_rows(pages).select("page_id", "url", "html")
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch in small_batches(batches):
            texts = [main_text(page, shared.value) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
