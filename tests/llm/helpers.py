"""Small inputs with the awkward cases every operator must take."""

from __future__ import annotations

import random

WORDS = ("the of and river stone light under every morning quiet garden window carries small old bridge water "
         "people walk slowly toward market where bread is sold before noon rain falls over roofs while children "
         "learn letters from painted boards").split()


def prose(seed: int, n: int) -> str:
    """``n`` words in lines of a dozen."""
    pick = random.Random(seed)
    words = [pick.choice(WORDS) + (str(pick.randrange(40)) if pick.random() < 0.3 else "") for _ in range(n)]
    return "\n".join(" ".join(words[i:i + 12]) + "." for i in range(0, n, 12))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, and repeated rows."""
    rows = [(i, prose(i, 80 + 7 * i), "en" if i % 3 else "de", f"src{i % 3}", None) for i in range(30)]
    rows += [(100, None, "en", "src0", None), (101, "", None, "src1", 0), (102, " \n\t ", "en", None, 4),
             (None, prose(3, 90), "en", "src0", None), (None, None, None, None, None),
             (103, prose(5, 6000), "de", "src2", None), (104, "one", "en", "src0", 3), (105, "x" * 70_000, "en", "src1", None)]
    rows += [rows[4], rows[4], rows[7]]
    rows += [(200 + i, rows[5][1], "en", "src0", None) for i in range(6)]  # equal texts
    return rows


def docs_of(spark, rows, extra: bool = False):
    """A documents table; with ``extra`` it has columns named like those that operators make."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("fp", "size", "taken", "kept", "score", "key", "h", "part", "label", "words", "row", "stats", "d",
                     "component_id", "n", "p", "host", "path", "none", "id", "first"):
            df = df.withColumn(name, F.lit(name))
    return df


def rows_of(df) -> list[tuple]:
    """Rows in an order that doesn't depend on Spark."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
