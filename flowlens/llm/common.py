"""Helpers shared by the operators: words, tables, row identity, bounded broadcasts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.session import shared_dir, stage

__all__ = ["SPACE", "broadcast_below", "broadcast_hint", "crc_of_id", "group_key", "let", "shared_dir", "shared_path",
           "small_batches", "spread_rows", "stage", "table", "text_of", "words_of"]

SPACE = r"[\x20\x09-\x0D]+"
#: Largest side that may be broadcast, and the most rows a small side may have: both are measured.
BROADCAST_BYTES = 32 << 20
#: Rows of text that Python code holds at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words, the longest runs without the six ASCII white-space characters."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def group_key(*columns: Column) -> Column:
    """One string for a tuple of values; null differs from every value, the empty text included."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")),
                        F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


def broadcast_below(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if a count proves that the side stays below ``limit`` bytes.

    Beyond it the planner picks a shuffle join, whose hot keys adaptive execution splits.
    """
    return broadcast_hint(df, row_bytes, limit)(df)


def broadcast_hint(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> Callable[[DataFrame], DataFrame]:
    """The hint, or none, for all tables of at most as many rows as ``df``, which is counted once."""
    most = limit // row_bytes
    return F.broadcast if df.limit(most + 1).count() <= most else lambda side: side


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal a table of very few files over the cores; larger tables stay where they are.

    ``inputFiles`` is metadata only. A local file of one row group would otherwise be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 4) else df


def small_batches(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches cut to few rows, so that long texts don't pile up in a Python worker."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
