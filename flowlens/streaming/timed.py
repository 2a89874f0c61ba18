"""Keyed operators in event time: rows wait for the watermark, are taken in order, and state expires.

A key's rows may come in any order within the watermark's delay, over any number of micro-batches. They wait
in a map state by time bucket, one entry for each Arrow batch that brought some, and a timer at the bucket's
end takes them, sorted, when the watermark has passed it. So a task holds one Arrow batch or one bucket of one
key, not a key's whole micro-batch, and behind the watermark only what the operator itself keeps is left.
Rows older than the watermark are late and left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlens import fixed_values as fv
from flowlens.streaming.keyed import ACTION_SCHEMA, OUTPUT_WINDOWS

BUCKET_MS = 10_000
DAY_MS = 86_400_000


def _milliseconds(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[ms]").astype(np.int64)


def _stored(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _restored(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


class InTimeOrder(StatefulProcessor):
    """Hands a key's rows to ``take`` in the order of time and ``ties``, bucket by bucket, none before its time.

    With ``keep_ms`` a key of which nothing has come for so long, in event time, is forgotten.
    """

    def __init__(self, ts: str, ties: Sequence[str] = (), bucket_ms: int = BUCKET_MS, keep_ms: int | None = None):
        self.ts, self.ties, self.bucket_ms, self.keep_ms = ts, list(ties), bucket_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", "rows binary")
        self.parts = handle.getValueState("parts", "n bigint")
        self.last = handle.getValueState("last", "ms bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """State of the operator itself."""

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def forget(self) -> None:
        """Clear the operator's state."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        n = self.parts.get()[0] if self.parts.exists() else 0
        for batch in rows:
            ms = _milliseconds(batch[self.ts])
            for bucket in np.unique(ms[ms >= mark] // self.bucket_ms).tolist():
                own = batch[(ms // self.bucket_ms == bucket) & (ms >= mark)]
                self.waiting.updateValue((bucket, n), (_stored(own),))
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)
                n += 1
        self.parts.update((n,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(b), int(p)) for b, p in self.waiting.keys())
        ready = [k for k in held if (k[0] + 1) * self.bucket_ms <= mark]
        for bucket in dict.fromkeys(b for b, _ in ready):
            own = [k for k in ready if k[0] == bucket]
            rows = pd.concat([_restored(self.waiting.getValue(k)[0]) for k in own], ignore_index=True)
            yield from self.take(key, rows.sort_values([self.ts, *self.ties], kind="stable"))
            for k in own:
                self.waiting.removeKey(k)
        if ready:
            self.last.update(((ready[-1][0] + 1) * self.bucket_ms,))
            if self.keep_ms is not None:
                self.handle.registerTimer((ready[-1][0] + 1) * self.bucket_ms + self.keep_ms)
        elif not held and self.keep_ms is not None and self.last.exists() and self.last.get()[0] + self.keep_ms <= mark:
            self.forget()
            self.last.clear()
        if len(ready) == len(held):
            self.parts.clear()

    def close(self) -> None:
        pass


class TimedWindows(InTimeOrder):
    """A window for every ``length`` rows of a key in event time; fewer than that are kept for the next."""

    def __init__(self, length: int, features: Sequence[str], ts: str, ties: Sequence[str], bucket_ms: int, keep_ms: int | None):
        super().__init__(ts, ties, bucket_ms, keep_ms)
        self.length, self.features = length, list(features)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getListState("rest", ", ".join(f"`{f}` double" for f in self.features) + ", target int")
        self.emitted = handle.getValueState("emitted", "n bigint")

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        columns = [*self.features, "target"]
        values = rows[columns].to_numpy(dtype=float)
        if self.rest.exists():
            values = np.concatenate([np.array(list(self.rest.get()), dtype=float), values])
        n = self.emitted.get()[0] if self.emitted.exists() else 0
        whole = len(values) // self.length
        cut = values[:whole * self.length].reshape(whole, self.length, len(columns))
        for at in range(0, whole, OUTPUT_WINDOWS):
            part = cut[at:at + OUTPUT_WINDOWS]
            y = (part[:, :, -1].mean(axis=1) >= fv.WINDOW_ATTACK_SHARE).astype(int)
            out = {"key": key[0], "seq": n + at + np.arange(len(part)), "y": y}
            yield pd.DataFrame(out | {f: list(part[:, :, i]) for i, f in enumerate(self.features)})
        self.rest.clear()
        rest = values[whole * self.length:]
        if len(rest):
            self.rest.put([(*map(float, r[:-1]), int(r[-1])) for r in rest])
        self.emitted.update((int(n + whole),))

    def forget(self) -> None:
        self.rest.clear()
        self.emitted.clear()


def timed_windows(stream: DataFrame, key: str, ts: str, features: Sequence[str], ties: Sequence[str] = (),
                  length: int = fv.WINDOW_LENGTH, bucket_ms: int = BUCKET_MS, keep_ms: int | None = None) -> DataFrame:
    """Windows of ``length`` rows per key in event time: ``(key, seq, y, features...)``.

    ``stream`` has a watermark on ``ts``. Rows that come out of order, over batches too, give the windows of
    the sorted input. A key that is forgotten loses its unfinished window and counts from 0 again.
    """
    schema = T.StructType([T.StructField("key", stream.schema[key].dataType),
                           T.StructField("seq", T.LongType()), T.StructField("y", T.IntegerType()),
                           *[T.StructField(f, T.ArrayType(T.DoubleType())) for f in features]])
    rows = stream.select(key, ts, *ties, "target", *[F.col(f).cast("double").alias(f) for f in features])
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=TimedWindows(length, features, ts, ties, bucket_ms, keep_ms), outputStructType=schema,
        outputMode="append", timeMode="eventTime")


class TimedActions(InTimeOrder):
    """Answers every action with the state of its source at the action's time.

    An incident opens or replaces the record; block closes it and emits the rule; report reads; ignore
    leaves it. At one time incidents come first, then actions by id.
    """

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "threat_id string, status string")

    def take(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        threat, status = self.record.get() if self.record.exists() else (None, None)
        out = []
        for r in rows.itertuples(index=False):
            if r.kind == 0:
                threat, status = r.threat_id, fv.STATUS_DETECTED
                continue
            found = threat is not None
            if found and r.action == "block":
                status = fv.STATUS_BLOCKED
            rule = fv.BLOCK_RULE.replace("{src_ip}", key[0]) if r.action == "block" else None
            out.append((key[0], int(r.action_id), r.action, found, threat, status, rule))
        if threat is not None:
            self.record.update((threat, status))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ACTION_SCHEMA.split(", ")])

    def forget(self) -> None:
        self.record.clear()


def answer_timed_actions(stream: DataFrame, bucket_ms: int = BUCKET_MS, keep_ms: int | None = DAY_MS) -> DataFrame:
    """Answers to the actions of ``keyed.incident_action_stream`` with a watermark on ``ts``.

    Actions and incidents may overtake each other within the watermark's delay; a late one isn't answered.
    A source without a row for ``keep_ms`` is forgotten: an action after that doesn't find its incident.
    """
    return stream.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=TimedActions("ts", ["kind", "action_id"], bucket_ms, keep_ms),
        outputStructType=ACTION_SCHEMA, outputMode="append", timeMode="eventTime")


class Registry(StatefulProcessor):
    """The last incident of each source and their number, until the source has been silent for ``keep_ms``."""

    def __init__(self, ts: str, ties: Sequence[str], fields: Sequence[str], keep_ms: int):
        self.ts, self.ties, self.fields, self.keep_ms = ts, list(ties), list(fields), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incident = handle.getValueState("incident", "row binary, n bigint, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        last, n, until = None, 0, None
        if self.incident.exists():
            blob, n, until = self.incident.get()
            last = _restored(blob)
        for batch in rows:  # one Arrow batch at a time; what stays of it is one row
            n += len(batch)
            both = batch if last is None else pd.concat([last, batch], ignore_index=True)
            last = both.sort_values([self.ts, *self.ties], kind="stable").tail(1)
        expires = int(_milliseconds(last[self.ts])[0]) + self.keep_ms
        if until != expires:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(expires)
        self.incident.update((_stored(last), n, expires))
        yield last[["src_ip", *self.fields]].assign(incidents=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.incident.clear()
        yield from ()

    def close(self) -> None:
        pass


def expiring_registry(incidents: DataFrame, ts: str = "ts", ties: Sequence[str] = (), keep_ms: int = DAY_MS) -> DataFrame:
    """Active incident per source (update mode): ``incidents``' columns and how many there were.

    ``incidents`` has a watermark on ``ts``. A source is dropped from the state when the watermark has passed
    its last incident by ``keep_ms``; should it return, its count begins anew.
    """
    fields = [f for f in incidents.columns if f != "src_ip"]
    schema = T.StructType([incidents.schema["src_ip"], *(incidents.schema[f] for f in fields), T.StructField("incidents", T.LongType())])
    return incidents.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=Registry(ts, ties, fields, keep_ms), outputStructType=schema, outputMode="update", timeMode="eventTime")
