"""Side-by-side check of a Spark result and a DuckDB result, exact in values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v + 0.0
    return v


def differences(df, con, sql: str, show: int = 5) -> str | None:
    """None if both agree in columns, kinds and the multiset of rows, else a description."""
    cols = sorted(df.columns)
    ours = Counter(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN"}
    kinds = [f"{c}: {spark_kinds[c]} against {duck_kinds[c]}" for c in cols
             if same.get(spark_kinds[c], spark_kinds[c]) != duck_kinds[c]]
    if kinds:
        return "types " + "; ".join(kinds)
    theirs = Counter(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if ours == theirs:
        return None
    a, b = list((ours - theirs).items())[:show], list((theirs - ours).items())[:show]
    return (f"{sum(ours.values())} rows against {sum(theirs.values())}; columns {cols}; "
            f"only here {a}; only there {b}; "
            f"{sum((ours - theirs).values())} differ")
