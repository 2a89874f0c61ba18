"""Daily CSV files of labelled flows: discovery, per-file gate and typed rows."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from flowlens.functions.numeric import binary_target, to_number
from flowlens.functions.timeparse import parse_time, pick_format
from flowlens.operators.quality import find_label_column, find_timestamp_column
from flowlens.operators.selection import allowed_columns
from flowlens.operators.windows import union_days

ROW_ORDER = ("row_block", "row_id")      # place of a row in its file, also the tie-break
DAMAGED = "_damaged"
SKIP_SCHEMA = "day string, reason string"


def discover_csv_files(spark: SparkSession, folder: str) -> list[str]:
    """``*.csv`` in the folder, else anywhere below it; sorted. Only the listing is read."""
    def listing(recursive: bool) -> list[str]:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
                 .option("recursiveFileLookup", str(recursive).lower()).load(folder))
        return sorted(unquote(path) for path in found.inputFiles())
    return listing(False) or listing(True)


def day_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def read_day_csv(spark: SparkSession, path: str) -> DataFrame:
    """One file, all columns as text, header trimmed; nothing is inferred from the data."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


@dataclass(frozen=True)
class Day:
    """A readable day: where its label and time are and which columns may be features."""

    path: str
    columns: tuple[str, ...]
    label: str
    timestamp: str | None
    time_format: str | None

    @property
    def name(self) -> str:
        return day_name(self.path)

    @property
    def features(self) -> list[str]:
        found = [self.label] + ([self.timestamp] if self.timestamp else [])
        return allowed_columns(self.columns, found)


def header_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """First line of every file that has one, by day, from one job over all files.

    The job reads lines only, keeps those of the files' first blocks and, per task, one line a file.
    """
    lines = spark.read.text(list(paths)).select(
        _file_name().alias("day"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    first = lines.where((F.col("block") == 0) & (F.trim("value") != "")).groupBy("day").agg(F.min_by("value", "place").alias("line"))
    return {r["day"]: r["line"] for r in first.collect()}


def _file_name() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def header_columns(line: str) -> tuple[str, ...]:
    """Trimmed names of a header; nameless and repeated ones are numbered by their place."""
    names = [c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]), [])]
    return tuple(f"_c{i}" if not c else c if names.index(c) == i else f"{c}{i}" for i, c in enumerate(names))


def raw_rows(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of files of one header as text, in one scan, with their day and place.

    A line that doesn't have the header's number of fields is in ``DAMAGED``, which is null for others.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, DAMAGED)])
    raw = (spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").option("columnPruning", "false")
           .option("enforceSchema", "true").option("columnNameOfCorruptRecord", DAMAGED).csv(list(paths)))
    return raw.select("*", _file_name().alias("day"), F.col("_metadata.file_block_start").alias("row_block"),
                      F.monotonically_increasing_id().alias("row_id"))


AUDIT_SCHEMA = ("day string, rows bigint, columns int, label_column string, timestamp_column string, status string, "
                "missing_values array<struct<column: string, missing: bigint>>, damaged bigint, first_time string")


def audit_files(spark: SparkSession, paths: Sequence[str]) -> list[dict]:
    """The audit of every file, in file order: a job for all headers and one for each different header.

    Damaged lines are counted apart and take no part in the other figures.
    """
    headers = header_lines(spark, paths)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        layouts.setdefault(header_columns(headers.get(day_name(path), "")), []).append(path)
    found: dict[str, Row] = {}
    for columns, same in layouts.items():
        if columns:
            ts, sound = find_timestamp_column(columns), F.col(DAMAGED).isNull()
            place = F.struct("row_block", "row_id")
            time = F.col(f"`{ts}`") if ts else F.lit(None).cast("string")
            counts = raw_rows(spark, same, columns).groupBy("day").agg(
                F.count_if(sound).alias("rows"), F.count_if(~sound).alias("damaged"),
                F.min_by(time, F.when(sound & time.isNotNull(), place)).alias("first_time"),
                F.array(*(F.count_if(sound & F.col(f"`{c}`").isNull()) for c in columns)).alias("missing"))
            found |= {r["day"]: r for r in counts.collect()}
    out = []
    for columns, same in layouts.items():
        for path in same:
            r, label = found.get(day_name(path)), find_label_column(columns)
            out.append({
                "path": path, "names": columns, "day": day_name(path), "rows": r["rows"] if r else 0, "columns": len(columns),
                "label_column": label, "timestamp_column": find_timestamp_column(columns),
                "status": "FAIL_EMPTY" if not columns else "PASS" if label else "FAIL_NO_LABEL",
                "missing_values": [(c, n) for c, n in zip(columns, r["missing"]) if n] if r else [],
                "damaged": r["damaged"] if r else 0, "first_time": r["first_time"] if r else None})
    order = {path: i for i, path in enumerate(paths)}
    return sorted(out, key=lambda x: order[x["path"]])


def audit_table(spark: SparkSession, audit: Sequence[dict]) -> DataFrame:
    fields = [c.split(" ")[0] for c in AUDIT_SCHEMA.replace("column: string, missing", "").split(", ")]
    return spark.createDataFrame([tuple(x[f] for f in fields) for x in audit], AUDIT_SCHEMA)


REASONS = {"FAIL_EMPTY": "no columns", "FAIL_NO_LABEL": "no label column"}


def days_of(spark: SparkSession, audit: Sequence[dict]) -> tuple[list[Day], DataFrame]:
    """Usable days in file order, and a table of the skipped ones with the reason."""
    days = [Day(x["path"], x["names"], x["label_column"], x["timestamp_column"],
                pick_format(x["first_time"]) if x["timestamp_column"] else None) for x in audit if x["status"] == "PASS"]
    skipped = [(x["day"], f"{REASONS[x['status']]} in {x['day']}") for x in audit if x["status"] != "PASS"]
    return days, spark.createDataFrame(skipped, SKIP_SCHEMA)


def open_days(spark: SparkSession, paths: Sequence[str]) -> tuple[list[Day], DataFrame]:
    """Audit files and tell usable days from skipped ones. The number of jobs doesn't grow with the files."""
    return days_of(spark, audit_files(spark, paths))


def damaged_rows(spark: SparkSession, days: Sequence[Day]) -> DataFrame:
    """``(day, row_block, row_id, reason, filled, line)``: lines of usable days that are set aside, and how many of
    the header's fields they fill."""
    parts = [raw_rows(spark, [d.path for d in same], columns).where(F.col(DAMAGED).isNotNull()).select(
        "day", "row_block", "row_id", F.lit("wrong number of fields").alias("reason"),
        F.size(F.filter(F.array(*(F.col(f"`{c}`") for c in columns)), lambda x: x.isNotNull())).alias("filled"), F.col(DAMAGED).alias("line"))
        for columns, same in _by(days, lambda d: d.columns).items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _by(days: Sequence[Day], key) -> dict:
    out: dict = {}
    for d in days:
        out.setdefault(key(d), []).append(d)
    return out


def layout_rows(spark: SparkSession, days: Sequence[Day], features: Sequence[str]) -> DataFrame:
    """Typed rows of days of one layout, in one scan: ``day, ts, row_block, row_id, target, features...``.

    Damaged rows and rows whose time does not parse are dropped; without a time column the file order
    stands. A feature the files lack is null here and becomes 0.0 with the other missing values.
    """
    one = days[0]
    raw = raw_rows(spark, [d.path for d in days], one.columns).where(F.col(DAMAGED).isNull())
    ts = parse_time(F.col(f"`{one.timestamp}`"), one.time_format) if one.timestamp else \
        F.lit("1970-01-01 00:00:00").cast("timestamp")
    cells = [to_number(F.col(f"`{f}`")).alias(f) if f in one.columns
             else F.lit(None).cast("double").alias(f) for f in features]
    rows = raw.select("day", ts.alias("ts"), "row_block", "row_id", binary_target(F.col(f"`{one.label}`")).alias("target"), *cells)
    return rows.where(F.col("ts").isNotNull())


def read_days(spark: SparkSession, days: Sequence[Day], features: Sequence[str]) -> DataFrame:
    """All usable days as one table: a scan for each layout of header, label and time, not for each file."""
    layouts = _by(days, lambda d: (d.columns, d.label, d.timestamp, d.time_format))
    both = union_days([layout_rows(spark, same, features) for same in layouts.values()])
    return both.na.fill(0.0, list(features))
