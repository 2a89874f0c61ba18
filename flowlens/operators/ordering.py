"""Ordered operators that never put one whole group into one task.

A plain window ``PARTITION BY day ORDER BY ts`` sends a day to a single task, and one
day (or model, or class) may hold a third of all rows. The operators here cut each group
into order-preserving buckets, total the buckets with a partial aggregate, and only then
run the window inside a bucket, adding what lies before it. The bucket functions are
deterministic, so a recomputed task gets the same answer and no checkpoint is needed.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import is_small, stage

ORDER_BUCKETS = ("_slot", "_path")
MINUTE = 60_000_000                 # microseconds
BUCKET_ROWS = 1_000_000             # a bucket of more rows is cut, whatever share of all rows it is
CUTS = 32                           # points at which a bucket is cut at once
MOST_ROUNDS = 16                    # of cutting by one column
MOST_LITERAL = 50_000               # crowded buckets whose cut points are broadcast
CUT_SALTS = 64                      # for rows of more hot buckets than can be broadcast
HASH_PREFIX = 4                     # hex digits: 65,536 hash buckets
LOG_BUCKETS_PER_OCTAVE = 64
SCORE_BUCKETS_PER_OCTAVE = 1024
FINE_BUCKETS = 4096


def running_totals(df: DataFrame, by: Sequence[str], bucket: Sequence[str],
                   order: Sequence[Column], sums: Mapping[str, str],
                   totals: Mapping[str, str] | None = None,
                   descending: bool = False) -> DataFrame:
    """Inclusive running sums per ``by`` group in ``order``.

    ``bucket`` columns must be monotone in ``order``. ``sums`` maps output name to the
    summed column, ``totals`` maps output name to a summed column for the whole group.
    """
    by, bucket = list(by), list(bucket)
    totals = dict(totals or {})
    key = by + bucket
    wanted = sorted(set(sums.values()) | set(totals.values()))
    per_bucket = df.groupBy(*key).agg(*[F.sum(c).alias(f"_b_{c}") for c in wanted])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(*[F.desc(c) if descending else F.asc(c) for c in bucket])
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *key,
        *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_before_{out}")
          for out, c in sums.items()],
        *[F.sum(f"_b_{c}").over(group).alias(out) for out, c in totals.items()])
    inside = (Window.partitionBy(*key).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = df.select("*", *[F.sum(c).over(inside).alias(f"_in_{out}")
                              for out, c in sums.items()])
    joined = ranked.join(offsets, key)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{out}") + F.col(f"_in_{out}")).alias(out) for out in sums],
        *totals.keys())


def minute_code(ts: str) -> Column:
    """Minutes since 1970 as written; taken from the fields, so no time zone shift."""
    t = F.col(ts)
    days = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 1440 + F.hour(t) * 60 + F.minute(t)


def time_code(ts: str) -> Column:
    """Microseconds since 1970 as written, like ``minute_code``."""
    return minute_code(ts) * MINUTE + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")


def order_buckets(df: DataFrame, ts: str, ties: Sequence[str], most: int | None = None) -> DataFrame:
    """Adds ``ORDER_BUCKETS``, monotone in the time and the tie-breaks, of at most ``most`` rows each.

    The first is the minute. A bucket of more rows is cut at points taken from its own values: of the time,
    and, where one time stamp alone is too many, of the numeric tie-breaks one after the other. The second
    column lists the pieces a row fell into. A value that is itself a cut point gets a piece of its own, so
    every cut tells values apart, however they are spread, and cutting ends when all buckets are small or
    hold one value of each column. Only counts, ends and cut points of crowded buckets are kept between
    rounds; without a crowded minute there is one counting job.
    """
    most = most or BUCKET_ROWS
    key = list(ORDER_BUCKETS)
    out = df.withColumns({"_slot": minute_code(ts), "_path": F.array().cast("array<int>")})
    kinds = dict(df.dtypes)
    numeric = [c for c in ties if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")]
    points = F.array(*(F.lit((k + 1) / (CUTS + 1)) for k in range(CUTS)))
    for value in (time_code(ts), *map(F.col, numeric)):
        for _ in range(MOST_ROUNDS):
            ends = out.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
            hot = ends.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).select(*key)
            found = hot.limit(MOST_LITERAL + 1).collect()
            if not found:
                break
            few = len(found) <= MOST_LITERAL
            hot = df.sparkSession.createDataFrame(found, hot.schema) if few else stage(hot, "crowded")
            crowd = out.join(F.broadcast(hot), key) if few else _salted(out, hot, key, "inner")
            cuts = stage(crowd.groupBy(*key).agg(F.array_distinct(F.percentile_approx(value, points, 10_000)).alias("_cuts")), "cuts")
            out = out.join(F.broadcast(cuts), key, "left") if few else _salted(out, cuts, key, "left")
            # twice the number of points below, one more on a point: so equal values share a piece
            piece = F.size(F.filter("_cuts", lambda c: c < value)) * 2 + F.array_contains("_cuts", value).cast("int")
            out = out.withColumn("_path", F.when(F.col("_cuts").isNotNull(), F.array_append("_path", piece)).otherwise(F.col("_path"))).drop("_cuts")
    return out


def _salted(rows: DataFrame, side: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Join of rows with one row a bucket, where the bucket's rows don't gather in a task."""
    spread = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(CUT_SALTS - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns[:-len(ORDER_BUCKETS)]), F.lit(CUT_SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(spread, [*key, "_salt"], how).drop("_salt")


def positional_index(df: DataFrame, by: Sequence[str], ts: str, ties: Sequence[str],
                     pos: str = "pos", total: str = "n") -> DataFrame:
    """Zero-based position of every row in its group by time, and the group size.

    ``ties`` make the order total; numeric ones can cut a crowded time stamp. One pass counts the rows of each
    minute: unless one is crowded, minutes are the buckets and nothing is read for finer ones.
    """
    by, bucket = list(by), ["_slot"]
    keyed = df.withColumn("_slot", minute_code(ts))
    counts = stage(keyed.groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_rows")), "minutes")
    if not counts.where(F.col("_rows") > BUCKET_ROWS).isEmpty():
        keyed, bucket = order_buckets(df, ts, ties), list(ORDER_BUCKETS)
        counts = keyed.groupBy(*by, *bucket).agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, *bucket, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                            F.sum("_rows").over(group).alias(total))
    inside = Window.partitionBy(*by, *bucket).orderBy(F.col(ts), *map(F.col, ties))
    ranked = keyed.select("*", F.row_number().over(inside).alias("_at"))
    return (ranked.join(offsets, [*by, *bucket])
            .select(*df.columns, (F.col("_before") + F.col("_at") - 1).alias(pos), total))


def hash_key(keys: Sequence[str], seed: int) -> Column:
    """Pseudo-random order of rows: md5 over the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_cutoffs(df: DataFrame, by: Sequence[str], keys: Sequence[str], quota: DataFrame,
                 seed: int) -> DataFrame:
    """Per group, the hash of its ``quota``-th row in hash order (one row per group).

    Counts by hash prefix find the one prefix that holds the cut; only its rows
    (1/65,536 of a group) are ranked. Groups smaller than their quota get 'g', which is
    above every hex digit.
    """
    by = list(by)
    h = df.select(*by, hash_key(keys, seed).alias("_h"))
    h = h.withColumn("_p", F.substring("_h", 1, HASH_PREFIX))
    counts = h.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy("_p")
    counts = counts.select(*by, "_p", "_c", (F.sum("_c").over(w) - F.col("_c")).alias("_before"))
    edge = (counts.join(F.broadcast(quota), by)
            .where((F.col("_before") < F.col("quota"))
                   & (F.col("_before") + F.col("_c") >= F.col("quota")))
            .select(*by, "_p", (F.col("quota") - F.col("_before")).alias("_left")))
    inside = Window.partitionBy(*by, "_p").orderBy("_h")
    cut = (h.join(F.broadcast(edge), by + ["_p"])
           .withColumn("_rn", F.row_number().over(inside))
           .where(F.col("_rn") == F.col("_left"))
           .select(*by, F.col("_h").alias("_cut")))
    return (quota.join(cut, by, "left")
            .select(*by, F.when(F.col("quota") <= 0, F.lit(""))
                    .otherwise(F.coalesce("_cut", F.lit("g"))).alias("_cut")))


def take_by_hash(df: DataFrame, by: Sequence[str], keys: Sequence[str], quota: DataFrame,
                 seed: int) -> DataFrame:
    """Exactly ``min(quota, group size)`` rows per group, without replacement.

    ``quota`` has the ``by`` columns and ``quota``; it holds one row per class, so it and
    the cut-offs are broadcast. The rows themselves are filtered in place, not shuffled.
    ``keys`` must identify a row.
    """
    cut = hash_cutoffs(df, by, keys, quota, seed)
    return (df.withColumn("_h", hash_key(keys, seed))
            .join(F.broadcast(cut), list(by))
            .where(F.col("_h") <= F.col("_cut"))
            .select(*df.columns))


def log_bucket(v: Column, per_octave: int = LOG_BUCKETS_PER_OCTAVE) -> Column:
    """Order-preserving bucket of a double with constant relative width.

    Infinities have the outermost buckets; NaN has none.
    """
    finite = F.least(F.abs(v), F.lit(sys.float_info.max))
    size = F.floor((F.log2(finite) + 1080.0) * per_octave) + 1
    size = F.when(F.abs(v) == float("inf"), size + 1).otherwise(size)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def score_bucket(p: Column) -> Column:
    """Order-preserving bucket of a score, fine near 0 and near 1 where scores crowd.

    Above one half the distance to 1 is bucketed; that difference is exact in doubles.
    """
    per = SCORE_BUCKETS_PER_OCTAVE
    top = 2 * 1080 * per
    return F.when(p <= 0.5, log_bucket(p, per)).otherwise(
        F.lit(top).cast("long") - log_bucket(1.0 - p, per))


def exact_quantiles(values: DataFrame, key: str, value: str,
                    probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key: ``(key, prob, q)``.

    Pruned passes narrow each wanted rank to a log bucket, then, if one has more than ``BUCKET_ROWS`` rows, to
    one of 4,096 equal parts of it, then to the value. Every pass counts with a partial aggregate, so
    neither a hot value nor a wide column piles up in one task. The targets carried
    between passes, at most ``2 * len(probs)`` rows per key, are written out so that no
    pass is repeated. ``values`` should be a stored or staged table.
    """
    v = (values.select(key, F.col(value).cast("double").alias("_v"))
         .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
         .withColumn("_b", log_bucket(F.col("_v"), SCORE_BUCKETS_PER_OCTAVE)))
    per_key = Window.partitionBy(key)
    coarse = v.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"),
                                      F.max("_v").alias("_hi"))
    coarse = coarse.select(
        "*", F.sum("_c").over(per_key).alias("_n"),
        (F.sum("_c").over(per_key.orderBy("_b")) - F.col("_c")).alias("_before"))
    h = (F.col("_n") - 1) * F.col("prob")
    targets = (coarse.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))))
               .where((F.col("_rank") >= F.col("_before"))
                      & (F.col("_rank") < F.col("_before") + F.col("_c")))
               .select(key, "prob", "_b", "_lo", "_hi", "_n", "_c",
                       (F.col("_rank") - F.col("_before")).alias("_r"),
                       "_rank"))
    targets = stage(targets, "quantile-buckets")
    few = F.broadcast if is_small(targets) else (lambda side: side)
    wide = F.col("_hi") > F.col("_lo")
    crowded = not targets.where(wide & (F.col("_c") > BUCKET_ROWS)).isEmpty()
    part = F.when(wide,
                  F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
                          * (FINE_BUCKETS - 1))).otherwise(F.lit(0).cast("long"))
    zoom = v.join(few(targets.select(key, "_b", "_lo", "_hi").distinct()), [key, "_b"])
    zoom = zoom.select(key, "_b", (part if crowded else F.lit(0).cast("long")).alias("_s"), "_v")
    if crowded:
        in_bucket = Window.partitionBy(key, "_b").orderBy("_s")
        fine = zoom.groupBy(key, "_b", "_s").agg(F.count(F.lit(1)).alias("_c"))
        fine = fine.select("*", (F.sum("_c").over(in_bucket) - F.col("_c")).alias("_before"))
        targets = (targets.drop("_c").join(fine, [key, "_b"])
                   .where((F.col("_r") >= F.col("_before"))
                          & (F.col("_r") < F.col("_before") + F.col("_c")))
                   .select(key, "prob", "_b", "_s", "_n", "_rank",
                           (F.col("_r") - F.col("_before")).alias("_r")))
        targets = stage(targets, "quantile-parts")
        zoom = zoom.join(few(targets.select(key, "_b", "_s").distinct()), [key, "_b", "_s"])
    else:
        targets = targets.select(key, "prob", "_b", F.lit(0).cast("long").alias("_s"), "_n", "_rank", "_r")
    in_part = Window.partitionBy(key, "_b", "_s").orderBy("_v")
    leaf = zoom.groupBy(key, "_b", "_s", "_v").agg(F.count(F.lit(1)).alias("_c"))
    leaf = leaf.select("*", (F.sum("_c").over(in_part) - F.col("_c")).alias("_before"))
    found = (targets.join(leaf, [key, "_b", "_s"])
             .where((F.col("_r") >= F.col("_before"))
                    & (F.col("_r") < F.col("_before") + F.col("_c"))))
    exact = found.groupBy(key, "prob").agg(
        F.max("_n").alias("_n"), F.min_by("_v", "_rank").alias("_a"),
        F.max_by("_v", "_rank").alias("_z"))
    frac = h - F.floor(h)
    return exact.select(key, "prob", (F.col("_a") + (F.col("_z") - F.col("_a")) * frac).alias("q"))


def global_index(df: DataFrame, day: str, ts: str, ties: Sequence[str],
                 pos: str = "pos") -> DataFrame:
    """Zero-based position over all days: rows of earlier days plus the position in the day."""
    indexed = positional_index(df, [day], ts, ties, pos="_at", total="_size")
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("_c"))
    earlier = (Window.partitionBy(F.lit(0)).orderBy(day)
               .rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(day, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start"))
    return (indexed.join(days, day).withColumn(pos, F.col("_start") + F.col("_at"))
            .select(*df.columns, pos))
