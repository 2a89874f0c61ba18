"""Cleaning and arithmetic on numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens import fixed_values as fv

# text that counts as a number: no type suffix such as 1.5d, which a cast would accept
NUMBER = (r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes 0. Infinities stay."""
    minus = F.ltrim(text).startswith("-")
    inf = F.when(minus, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.coalesce(F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
                      .when(text.rlike(INFINITE), inf), F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    """NaN and both infinities become 0; null does too."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(F.when(bad, F.lit(0.0)).otherwise(c), F.lit(0.0))


def finite_or_zero_array(c: Column) -> Column:
    return F.transform(c, finite_or_zero)


def clip(c: Column, bound: float) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), c))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def softmax_positive(negative: Column, positive: Column) -> Column:
    """Positive probability of two logits."""
    return 1.0 / (1.0 + F.exp(negative - positive))


def binary_target(label: Column) -> Column:
    """0 for benign in any case and padding, else 1; a missing label counts as an attack."""
    return F.when(F.lower(F.trim(label, F.lit(" \t\n\r\x0b\x0c"))) == fv.BENIGN_LABEL,
                  0).otherwise(1)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
