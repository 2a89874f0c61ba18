"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function."""
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn
    return add


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body
