"""Live detection: score arriving windows, keep the incident registry, count, alert.

The stateful parts that aggregate (registry, counters) are built-in streaming aggregations:
they combine before the shuffle, so a very active source costs one row per task. Only the
two operators whose answer depends on the order of a key's rows hold per-key state in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens import fixed_values as fv
from flowlens.operators.incidents import incident_numbers, verdict
from flowlens.operators.scaling import apply_robust_windows
from flowlens.operators.windows import window_table_stats
from flowlens.sources.requests import parse_requests, split_requests
from flowlens.sources.sinks import append_alerts

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "1 hour"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory; needed by the keyed operators below."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def with_event_time(stream: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Event time with a watermark; a zone-less timestamp is read as UTC session time."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# ---------------------------------------------------------------- scoring

def request_windows(requests: DataFrame, features: Sequence[str]) -> DataFrame:
    """Request matrices as one array column per feature."""
    def column_of(i: int):
        return F.transform("features", lambda step: step[i])

    return requests.withColumns({f: column_of(i) for i, f in enumerate(features)})


def score_requests(raw: DataFrame, features: Sequence[str], length: int,
                   params: dict[str, tuple[float, float]], model,
                   threshold: float = fv.DETECT_THRESHOLD, body: str = "value",
                   clip: float = fv.CLIP_SERVING) -> tuple[DataFrame, DataFrame]:
    """Detections and rejected requests; works on a batch and on a stream alike.

    Every step is a projection, so nothing is shuffled between the source and the verdict.
    """
    carried = [c for c in raw.columns if c != body]
    good, bad = split_requests(parse_requests(raw, body), length, len(features))
    table = apply_robust_windows(request_windows(good, features), features, params, clip)
    keep = [*carried, "src_ip", "dst_port", "protocol"]
    stats = window_table_stats(table, features, keep)
    p = vector_to_array("probability")[1]
    scored = model.transform(stats).select(*keep, p.alias("p"))
    v = verdict(F.col("p"), threshold)
    return scored.withColumns(v), bad.select(*carried, "src_ip", "error")


# ---------------------------------------------------------------- aggregations

def live_registry(incidents: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Active incident per source, last one wins (update or complete mode)."""
    rest = [c for c in incidents.columns if c != "src_ip"]
    return incidents.groupBy("src_ip").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("incident"),
        F.count(F.lit(1)).alias("incidents"))


def live_counters(detections: DataFrame) -> DataFrame:
    """Running totals for the health and metrics pages."""
    return detections.groupBy().agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("is_threat")).alias("threats"),
        F.max("probability").alias("top_probability"))


def daily_counts(stream: DataFrame, kind: str, ts: str = "ts") -> DataFrame:
    """Rows per calendar day and kind; late rows within the watermark are counted."""
    return with_event_time(stream, ts).groupBy(F.window(ts, "1 day"), kind).agg(
        F.count(F.lit(1)).alias("rows")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), kind, "rows")


# ---------------------------------------------------------------- per batch

def number_batch(batch: DataFrame, batch_id: int, counts_path: str, day: str, ts: str,
                 ties: Sequence[str]) -> DataFrame:
    """Incident ids that go on from the earlier batches.

    Each batch keeps the number of incidents up to its end under its own id, so it reads the one
    before and a repeated batch gets the same numbers. Where a batch was left out, all are looked
    through for the last one before.
    """
    spark = batch.sparkSession
    kept = spark.read.schema("total bigint")
    before = 0
    if batch_id > 0:
        try:
            before = kept.parquet(f"{counts_path}/batch_id={batch_id - 1}").first()[0]
        except AnalysisException:                      # that batch has no record
            earlier = spark.read.schema("total bigint, batch_id bigint").parquet(counts_path).where(
                F.col("batch_id") < batch_id)
            before = earlier.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    batch.agg((F.count(F.lit(1)) + F.lit(int(before))).alias("total")).write.mode(
        "overwrite").parquet(f"{counts_path}/batch_id={batch_id}")
    return incident_numbers(batch, day, ts, ties, start=int(before) + 1)


def alert_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for ``foreachBatch``: one partition per batch; a batch that can't be written stops the
    stream uncommitted, so that none is lost."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_alerts(batch, path, batch_id)
    return write


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None],
             mode: str = "append"):
    """Work off all that is available, then stop."""
    return (stream.writeStream.foreachBatch(sink).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
