"""Event times from text: one format per file, chosen from its first value."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

DAY_FIRST = "dd/MM/yyyy HH:mm:ss"
FORMATS = (
    (re.compile(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"), "d/M/yyyy H:mm:ss"),
    (re.compile(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$"), "d/M/yyyy h:mm:ss a"),
    (re.compile(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"), "d/M/yyyy H:mm"),
    (re.compile(r"^\d{1,2}/\d{1,2}/\d{4}$"), "d/M/yyyy"),
    (re.compile(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), "yyyy-MM-dd HH:mm:ss"),
    (re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), "yyyy-MM-dd'T'HH:mm:ss"),
    (re.compile(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+$"), "yyyy-MM-dd HH:mm:ss[.SSSSSS]"),
    (re.compile(r"^\d{4}-\d{2}-\d{2}$"), "yyyy-MM-dd"),
)


def pick_format(first_value: str | None) -> str:
    """Format of a column by its first value, day before month; the day-first form if unknown."""
    for pattern, fmt in FORMATS:
        if first_value and pattern.match(first_value.strip()):
            return fmt
    return DAY_FIRST


def parse_time(text: Column, fmt: str) -> Column:
    """Timestamp, or null where the text does not follow the format."""
    return F.try_to_timestamp(F.trim(text), F.lit(fmt))
