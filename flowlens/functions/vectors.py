"""Dense vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; inside a lambda it would be per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0),
                              lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(
        a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def min_max(a: Column) -> Column:
    """Scale an array to [0, 1]; a constant array becomes 0.5 throughout."""
    ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    return let(ends, lambda e: F.transform(
        a, lambda x: F.when(e["hi"] - e["lo"] < 1e-10, F.lit(0.5))
        .otherwise((x - e["lo"]) / (e["hi"] - e["lo"]))))


def first_max(a: Column) -> Column:
    """One-based position of the largest element, the first one on ties."""
    return F.array_position(a, F.array_max(a)).cast("int")
