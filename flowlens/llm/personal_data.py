"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

Texts are cut into letter runs, digit runs and single signs, line by line. A token is known by its type: a
word of the labelled table, else its shape and length. The field scores a tag by the types around a token and
by the tag before it; it is trained on the driver from the small labelled table and decoded by Viterbi for
many lines at once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.common import small_batches, spread_rows, text_of
from flowlens.llm.personal_table import SENTENCES, plain_lines

#: Kinds in the order of spans that start together; patterns find the first four, the model adds to some.
KINDS = ("email", "ip", "card", "phone", "person")
PATTERNS = KINDS[:4]
LEARNT = ("email", "card", "phone", "person")
TAGS = ("O", *(f"{at}-{kind}" for kind in LEARNT for at in "BI"))
#: Digits that a number found by the model must have.
DIGITS = {"phone": (7, 15), "card": (12, 19)}

#: What an address that is spelt out must hold between its parts.
_SPELT = re.compile(r"(?i)(?<!\w)(at|arobase|arroba)(?!\w).+(?<!\w)(dot|punkt|point|punto)(?!\w)")

#: Tokens around a token whose types count.
AROUND = (-2, -1, 0, 1, 2)
RIDGE = 0.05
ROUNDS = 150
#: A line is cut at white space so that no part is longer; code points whose tokens are held at once; cells of
#: a Viterbi table.
LINE_POINTS = 1 << 16
HELD_POINTS = 1 << 18
TABLE_CELLS = 1 << 16
FORBIDDEN = -1e4

# ---------------------------------------------------------------- patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match can't begin inside a run of digits and not at its start, so only starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of emails, addresses, cards and phones, leftmost and apart within a kind.

    Linear in the text: an email is sought from its @ to both sides.
    """
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = _OTHER.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- tokens

SPACE, LINE, LOWER, UPPER, DIGIT, SIGN = range(6)
#: Code points that have a class of their own; all others are lower-case letters.
_TABLE = 0x3000
_LETTERS = 4 * 6
_DIGITS = 21
#: Types: nothing, letters by case and length, digits by their number, ASCII signs, other signs, known words.
PAD, FIRST_SHAPE, FIRST_DIGIT, FIRST_SIGN = 0, 1, 1 + _LETTERS, 1 + _LETTERS + _DIGITS
FIRST_WORD = FIRST_SIGN + 129


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of the first code points, and an entry for all others."""
    kinds = np.full(_TABLE + 1, LOWER, np.uint8)
    lower = np.arange(_TABLE + 1, dtype=np.int64)
    for c in range(_TABLE):
        x, kind = chr(c), unicodedata.category(chr(c))
        kinds[c] = (LINE if x == "\n" else SPACE if x.isspace() or kind == "Cc" else DIGIT if "0" <= x <= "9" else
                    UPPER if kind in ("Lu", "Lt") else LOWER if kind[0] in "LM" else SIGN)
        low = x.lower()
        lower[c] = ord(low) if len(low) == 1 and ord(low) < _TABLE else c
    return kinds, lower


@dataclass
class Tokens:
    text: str
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    shape: np.ndarray
    #: Length and first four letters, lower-cased, of letter runs; 0 for other tokens.
    head: np.ndarray


def tokens_of(text: str) -> Tokens:
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _TABLE).astype(np.int32)
    if not len(points):
        return Tokens(text, *(np.zeros(0, np.int64) for _ in range(5)))
    kinds, lower = _classes()
    kind = kinds[points]
    upper = kind == UPPER
    kind[upper] = LOWER
    edge = np.empty(len(points), bool)
    edge[0] = True
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SIGN)
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(points))
    own = kind[start]
    real = own > LINE
    line = np.cumsum(np.where(own == LINE, end - start, 0))[real]
    start, end, own = start[real], end[real], own[real]
    size = end - start
    count = np.concatenate([[0], np.cumsum(upper, dtype=np.int32)])
    n_upper = count[end] - count[start]
    case = np.where(n_upper == 0, 0, np.where((n_upper == 1) & upper[start], 1, np.where(n_upper == size, 2, 3)))
    letters = own == LOWER
    shape = np.where(letters, FIRST_SHAPE + case * 6 + _BUCKETS[np.minimum(size, len(_BUCKETS) - 1)], np.where(
        own == DIGIT, FIRST_DIGIT + np.minimum(size, _DIGITS) - 1, FIRST_SIGN + np.minimum(points[start], 128)))
    head = np.minimum(size, 255)
    for k in range(4):
        head = (head << 14) | np.where(size > k, lower[points[np.minimum(start + k, len(points) - 1)]], 0)
    return Tokens(text, start, end, line, shape, np.where(letters, head, 0))


_BUCKETS = np.array([0, 0, 1, 2, 2, 3])


def known_words(words) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Heads of known words in order, the place of the word of each head that is its whole word, else -1, and all places."""
    words = sorted(words)
    heads = tokens_of(" ".join(words)).head if words else np.zeros(0, np.int64)
    assert len(heads) == len(words)
    seen, first = np.unique(heads, return_index=True)
    return seen, np.array([i if len(words[i]) <= 4 else -1 for i in first.tolist()], np.int64), {w: i for i, w in enumerate(words)}


# ---------------------------------------------------------------- model

@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""
    words: tuple            # known words, see known_words
    emit: np.ndarray        # (around, type, tag)
    gaps: np.ndarray        # (space before, space after, tag)
    move: np.ndarray        # (tag, tag)
    first: np.ndarray
    last: np.ndarray

    def types(self, t: Tokens) -> np.ndarray:
        heads, whole, places = self.words
        out = t.shape.copy()
        if not len(heads):
            return out
        at = np.minimum(np.searchsorted(heads, t.head), len(heads) - 1)
        hit = heads[at] == t.head
        short = hit & (whole[at] >= 0)
        out[short] = FIRST_WORD + whole[at[short]]
        for i in np.flatnonzero(hit & ~short).tolist():
            place = places.get(t.text[t.start[i]:t.end[i]].lower())
            if place is not None:
                out[i] = FIRST_WORD + place
        return out


@dataclass
class Lines:
    """Tokens of many lines with room between the lines, so that neighbours are found by shifting."""
    types: np.ndarray       # padded
    place: np.ndarray       # of each token in the padded
    gap: np.ndarray         # 1 where white space stands before
    after: np.ndarray
    bounds: np.ndarray      # first token of each line, and the end


def lines_of(t: Tokens, types: np.ndarray) -> Lines:
    reach = max(AROUND)
    new = np.diff(t.line, prepend=-1) > 0
    place = np.arange(len(types)) + reach * np.cumsum(new)
    padded = np.zeros(len(types) + reach * (int(new.sum()) + 2), np.int64)
    padded[place] = types
    gap = np.ones(len(types), np.int64)
    gap[1:] = (t.start[1:] > t.end[:-1]) | new[1:]
    after = np.ones(len(types), np.int64)
    after[:-1] = gap[1:]
    return Lines(padded, place, gap, after, np.append(np.flatnonzero(new), len(types)))


def emissions(field: Field, lines: Lines, at: np.ndarray) -> np.ndarray:
    out = np.take(field.gaps.reshape(4, -1), lines.gap[at] * 2 + lines.after[at], axis=0)
    place = lines.place[at]
    for k, around in enumerate(AROUND):
        out += np.take(field.emit[k], np.take(lines.types, place + around), axis=0)
    return out


def doubtful(field: Field, lines: Lines, scores: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of tokens, each within a line, outside which the best path is O throughout.

    A run of one kind begins with its B. Off O it gains that token's lead over O, the moves into and out of
    the run, and for each further token its lead and a move inside; no run follows another at once. A token
    that lies in no run which can gain is O on a best path, and O on both sides of a stretch sets it apart.
    """
    own, line = field.move[0, 0], np.repeat(np.arange(len(lines.bounds) - 1), np.diff(lines.bounds))
    covered = np.zeros(len(scores) + 1, np.int64)
    for b in range(1, len(TAGS), 2):
        kind = [b, b + 1]
        into = max(field.move[0, b] - own, field.first[b] - field.first[0])
        out = max((field.move[kind, 0] - own).max(), (field.last[kind] - field.last[0]).max())
        stay = field.move[kind, b + 1].max() - own
        inside = np.cumsum(scores[:, b + 1].astype(np.float64) - scores[:, 0] + stay)
        # lines far apart, so that the best end after a token is one of its own line
        apart = 1.0 + 2 * (np.abs(inside).max() if len(inside) else 0.0)
        ends = np.maximum.accumulate((inside - apart * line)[::-1])[::-1] + apart * line
        gain = scores[:, b] - scores[:, 0] + into + out + 1e-3
        for t in np.flatnonzero(gain + ends - inside >= 0).tolist():
            onward = inside[t:lines.bounds[line[t] + 1]] - inside[t] + gain[t]
            covered[t] += 1
            covered[t + 1 + int(np.flatnonzero(onward >= 0)[-1])] -= 1
    within = np.cumsum(covered[:-1]) > 0
    edge = np.diff(line, prepend=-1) > 0
    begins = within & (edge | ~np.concatenate([[False], within[:-1]]))
    first = np.flatnonzero(begins)
    stops = np.flatnonzero(within & np.concatenate([(edge | ~within)[1:], [True]]))
    return list(zip(first.tolist(), (stops + 1).tolist()))


def viterbi(field: Field, scores: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best tags of stretches of the given sizes, whose scores follow each other; all stretches step together.

    ``first`` and ``last`` have, for each stretch, what it costs to begin and to end with a tag.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    tags = np.zeros(len(scores), np.int8)
    low = 0
    while low < len(order):
        longest = int(sizes[order[low]])
        part = order[low:low + max(1, TABLE_CELLS // longest)]
        low += len(part)
        size, start = sizes[part], starts[part]
        best = first[part] + scores[start]
        came = np.zeros((longest, len(part), len(TAGS)), np.int8)
        tag = np.zeros(len(part), np.int64)
        alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # stretches longer than t
        for t, n in enumerate(alive):
            if t:
                step = best[:n, :, None] + field.move
                came[t, :n] = step.argmax(axis=1)
                best[:n] = step.max(axis=1) + scores[start[:n] + t]
            done = np.flatnonzero(size[:n] == t + 1)
            tag[done] = (best[done] + last[part[done]]).argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            tags[start[:n] + t] = tag[:n]
            if t:
                tag[:n] = came[t, np.arange(n), tag[:n]]
    return tags


def decode(field: Field, lines: Lines, scores: np.ndarray) -> np.ndarray:
    """The best tags of all tokens."""
    tags = np.zeros(len(scores), np.int8)
    found = doubtful(field, lines, scores)
    if found:
        low, high = np.array(found).T
        at = np.concatenate([np.arange(a, b) for a, b in found])
        edges = np.zeros(len(scores) + 1, bool)
        edges[lines.bounds] = True
        first = np.where(edges[low][:, None], field.first, field.move[0])
        last = np.where(edges[high][:, None], field.last, field.move[:, 0])
        tags[at] = viterbi(field, scores[at], first, last, high - low)
    return tags


def marked(sentences: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Plain sentences and their spans (kind, start, end)."""
    out = []
    for line in sentences.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"<(\w+)>(.*?)</\1>", line):
            text += line[at:m.start()]
            spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
            text, at = text + m.group(2), m.end()
        out.append((text + line[at:], spans))
    return out


def _rows(table, t: Tokens) -> np.ndarray:
    """Tags of the tokens of the table's sentences, which stand one a line."""
    tags = np.zeros(len(t.start), np.int64)
    base = 0
    for text, spans in table:
        for kind, low, high in spans:
            inside = np.flatnonzero((t.start >= base + low) & (t.end <= base + high))
            tags[inside] = TAGS.index(f"I-{kind}")
            tags[inside[0]] = TAGS.index(f"B-{kind}")
        base += len(text) + 1
    return tags


def sparse_sum(types: np.ndarray, size: int):
    """Sums rows by type."""
    order = np.argsort(types, kind="stable")
    seen, first = np.unique(types[order], return_index=True)

    def run(rows):
        out = np.zeros((size, rows.shape[1]))
        out[seen] = np.add.reduceat(rows[order], first)
        return out
    return run


def objective(field: Field, lines: Lines, tags: np.ndarray, ridge: float, near: list) -> tuple[float, Field]:
    """Negative log likelihood of the tags with the ridge's term, and its gradient, by forward and backward sums."""
    at = np.arange(len(tags))
    scores = emissions(field, lines, at)
    grad = Field(field.words, *(ridge * w for w in (field.emit, field.gaps, field.move, field.first, field.last)))
    loss = sum(ridge / 2 * float((w * w).sum()) for w in (field.emit, field.gaps, field.move, field.first, field.last))
    move = np.where(_FORBIDDEN_MOVES, FORBIDDEN, field.move)
    first = np.where(_FORBIDDEN_FIRST, FORBIDDEN, field.first)
    sizes, starts = np.diff(lines.bounds), lines.bounds[:-1]
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]
    longest = int(sizes[0])
    total = lambda x: (m := x.max(axis=1, keepdims=True), np.log(np.exp(x - m).sum(axis=1)) + m[:, 0])[1]
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]
    ahead = [first + scores[starts]]
    for t in range(1, longest):
        n = alive[t]
        ahead.append(total(ahead[-1][:n, :, None] + move) + scores[starts[:n] + t])
    back = [None] * longest
    end = np.zeros(len(sizes))
    share = np.zeros_like(scores)
    for t in range(longest - 1, -1, -1):
        n, m = alive[t], alive[t + 1]
        back[t] = np.tile(field.last, (n, 1))
        if m:
            onward = move + (scores[starts[:m] + t + 1] + back[t + 1])[:, None, :]
            back[t][:m] = total(onward.swapaxes(1, 2))
        end[:n] = total(ahead[t][:, :, None] + back[t][:, :, None])[:, 0]
        share[starts[:n] + t] = np.exp(ahead[t] + back[t] - end[:n, None])
        if m:
            grad.move += np.exp(ahead[t][:m, :, None] + onward - end[:m, None, None]).sum(axis=0)
    own = np.zeros_like(scores)
    own[at, tags] = 1
    told, before = tags[starts], np.delete(at, lines.bounds[:-1])
    loss += end.sum() - scores[at, tags].sum() - first[told].sum() - field.last[tags[lines.bounds[1:] - 1]].sum()
    loss -= move[tags[before - 1], tags[before]].sum()
    np.add.at(grad.move, (tags[before - 1], tags[before]), -1)
    grad.first += (share - own)[starts].sum(axis=0)
    grad.last += (share - own)[lines.bounds[1:] - 1].sum(axis=0)
    np.add.at(grad.gaps, (lines.gap, lines.after), share - own)
    for k, summed in enumerate(near):
        grad.emit[k] += summed(share - own)
    return float(loss), grad


# a span goes on inside its kind only, and something stands between two spans
_FORBIDDEN_MOVES = np.array([[b[0] == "I" and a[1:] != b[1:] or a != "O" and b[0] == "B" for b in TAGS] for a in TAGS])
_FORBIDDEN_FIRST = np.array([b[0] == "I" for b in TAGS])


def train(sentences: str = SENTENCES, plain: str | None = None, ridge: float = RIDGE, rounds: int = ROUNDS) -> Field:
    """Fit the field to the table by resilient steps: each weight's step grows while its gradient keeps its sign.

    Words that the marked sentences hold twice are known by themselves. ``plain`` are lines without spans.
    """
    table = marked(sentences)
    known = Counter(w for text, _ in table for w in re.findall(r"[^\W\d_]+", text.lower()))
    table += [(line, []) for line in (plain_lines() if plain is None else plain).split("\n") if line]
    t = tokens_of("\n".join(text for text, _ in table))
    words = known_words(w for w, n in known.items() if n > 1)
    field = Field(words, *(np.zeros(s) for s in (
        (len(AROUND), FIRST_WORD + len(words[2]), len(TAGS)), (2, 2, len(TAGS)), (len(TAGS), len(TAGS)), len(TAGS), len(TAGS))))
    lines, tags = lines_of(t, field.types(t)), _rows(table, t)
    near = [sparse_sum(lines.types[lines.place + around], field.emit.shape[1]) for around in AROUND]
    names = ("emit", "gaps", "move", "first", "last")
    steps = {n: np.full_like(getattr(field, n), 0.05) for n in names}
    was = {n: np.zeros_like(getattr(field, n)) for n in names}
    for _ in range(rounds):
        _, grad = objective(field, lines, tags, ridge, near)
        for n in names:
            g, weights = getattr(grad, n), getattr(field, n)
            same = np.sign(g) * np.sign(was[n])
            steps[n] = np.clip(steps[n] * np.where(same > 0, 1.2, np.where(same < 0, 0.5, 1.0)), 1e-6, 0.5)
            g = np.where(same < 0, 0.0, g)
            weights -= np.sign(g) * steps[n]
            was[n] = g
    field.move[_FORBIDDEN_MOVES] = FORBIDDEN
    field.first[_FORBIDDEN_FIRST] = FORBIDDEN
    field.emit, field.gaps = field.emit.astype(np.float32), field.gaps.astype(np.float32)
    return field


def learnt_spans(field: Field, text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) that the model finds in lines of a text."""
    t = tokens_of(text)
    if not len(t.start):
        return []
    lines = lines_of(t, field.types(t))
    tags = decode(field, lines, emissions(field, lines, np.arange(len(t.start))))
    # a span starts at each B and goes on through the I after it
    out = []
    for b in np.flatnonzero(tags % 2 == 1).tolist():
        e = b
        while e + 1 < len(tags) and tags[e + 1] == tags[b] + 1 and t.line[e + 1] == t.line[b]:
            e += 1
        kind = LEARNT[(tags[b] - 1) // 2]
        low, high = int(t.start[b]), int(t.end[e])
        need = DIGITS.get(kind)
        fits = _SPELT.search(text, low, high) if kind == "email" else (
            need is None or need[0] <= sum(c in "0123456789" for c in text[low:high]) <= need[1])
        if fits:
            out.append((low, KINDS.index(kind), high))
    return out


def parts_of(text: str, longest: int = LINE_POINTS) -> list[tuple[int, str]]:
    """The text in order, cut after white space, line ends first, where it is longer: no part exceeds ``longest``."""
    out, low = [], 0
    while len(text) - low > longest:
        high = max(text.rfind("\n", low, low + longest), -1) + 1
        high = high if high > low else text.rfind(" ", low, low + longest) + 1
        high = high if high > low else low + longest
        out.append((low, text[low:high]))
        low = high
    out.append((low, text[low:]))
    return out


def find_all(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """Per text the spans of the patterns, and those that the model adds, none of which meets one of a pattern."""
    base = [pattern_spans(x) for x in texts]
    added = [[] for _ in texts]
    parts = [(i, low, part) for i, x in enumerate(texts) for low, part in parts_of(x)]
    k = 0
    while k < len(parts):
        held, n = [], 0
        while k < len(parts) and (not held or n + len(parts[k][2]) < HELD_POINTS):
            held.append((n, *parts[k]))
            n += len(parts[k][2]) + 1
            k += 1
        begins = [h[0] for h in held]
        for start, kind, end in learnt_spans(field, "\n".join(h[3] for h in held)):
            h = held[int(np.searchsorted(begins, start, side="right")) - 1]
            added[h[1]].append((start - h[0] + h[2], kind, end - h[0] + h[2]))
    for i, spans in enumerate(base):
        taken = sorted((s, e) for s, _, e in spans)
        ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
        added[i] = [x for x in added[i] if not taken or not (
            (p := int(np.searchsorted([s for s, _ in taken], x[2]))) and ends[p - 1] > x[0])]
    return list(zip(base, added))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document.

    The four numbers and the digest are of the patterns' spans; ``spans`` has those of the model, too, and
    ``n_added`` tells how many they are. Offsets are code points, the end exclusive. ``docs`` needs doc_id and
    text; other columns are ignored. Null and empty texts have no spans. Each copy of a repeated row has its
    own row; an empty table gives an empty result. The model doesn't look across ends of lines, nor across the
    cuts of lines beyond ``LINE_POINTS`` code points; patterns look at the whole text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} bigint' for k in PATTERNS)}, "
              "base_sha256 string, spans string, n_added bigint")

    def run(batches):
        for batch in small_batches(batches):
            found = find_all(shared.value, batch.column(1).to_pylist())
            counts = [[sum(kind == k for _, kind, _ in base) for base, _ in found] for k in range(len(PATTERNS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([_joined(base + added) for base, added in found], pa.string()),
                 pa.array([len(added) for _, added in found], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in PATTERNS), "base_sha256", "spans", "n_added"])

    return spread_rows(docs).select("doc_id", text_of("text").alias("text")).mapInArrow(run, schema)
