"""Text columns: tokens, n-grams, templated rules and report labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]+"      # Unicode white space
WORD = r"[\p{L}\p{N}_]+"                        # Unicode letters, digits, underscore


def whitespace_tokens(text: Column) -> Column:
    """Lower-case pieces between white space; punctuation stays on the piece."""
    return F.filter(F.split(F.lower(text), WHITESPACE), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by the pairs of neighbours, joined by a blank."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.concat(tokens, F.zip_with(F.slice(tokens, F.lit(1), pairs),
                                       F.slice(tokens, F.lit(2), pairs),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def render_rules(rules: Column, src_ip: Column) -> Column:
    """Fill the source address into every rule of an array."""
    return F.transform(rules, lambda r: F.replace(r, F.lit("{src_ip}"), src_ip))


def rules_excerpt(rules: Column, src_ip: Column, first: int = 3, chars: int = 120) -> Column:
    """First rules, one per line, cut for the report."""
    return F.substring(F.array_join(F.slice(render_rules(rules, src_ip), 1, first), "\n"), 1, chars)


def explain_query(names: Column) -> Column:
    """Feature names to retrieval text: joined, lower case, underscores as blanks."""
    return F.replace(F.lower(F.array_join(names, " ")), F.lit("_"), F.lit(" "))


def count_label(n: Column, pct: Column) -> Column:
    """Cell label of a confusion figure: grouped count, then the row percentage."""
    return F.concat(F.format_number(n, 0), F.lit("\n("), F.format_string("%.1f", pct), F.lit("%)"))


def percent(fraction: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", fraction * 100.0), F.lit("%"))
