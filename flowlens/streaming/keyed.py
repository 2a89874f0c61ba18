"""Operators with per-key state: actions on incidents, and windows by row count.

Both see one key's rows of one micro-batch; the source's rate limit (files or offsets per
trigger) bounds that. State per key is one small record or at most nine rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlens import fixed_values as fv

# Windows handed on at once.
OUTPUT_WINDOWS = 1000
ACTION_SCHEMA = ("src_ip string, action_id bigint, action string, found boolean, "
                 "threat_id string, status string, rule string")


def incident_action_stream(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Both streams in one shape. Source and action are two columns, so neither is parsed."""
    blank = F.lit(None).cast("string")
    return incidents.select(
        "src_ip", "ts", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("action_id"),
        blank.alias("action"), "threat_id").unionByName(actions.select(
            "src_ip", "ts", F.lit(1).alias("kind"), "action_id", "action",
            blank.alias("threat_id")))


class ActionProcessor(StatefulProcessor):
    """Answers every action with the state of its source at that time.

    An incident opens or replaces the record; block closes it and emits the rule; report
    reads; ignore leaves it. Rows of a batch are taken in time order, incidents first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "threat_id string, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(
            ["ts", "kind", "action_id"], kind="stable")
        threat, status = self.record.get() if self.record.exists() else (None, None)
        out = []
        for r in batch.itertuples(index=False):
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

    def close(self) -> None:
        pass


def answer_actions(stream: DataFrame) -> DataFrame:
    return stream.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=ActionProcessor(), outputStructType=ACTION_SCHEMA,
        outputMode="append", timeMode="none")


class CountWindowProcessor(StatefulProcessor):
    """Emits a window for every ``length`` rows of a key and carries the rest over.

    A key's rows of a micro-batch come in several Arrow batches, in no order. Their numbers are
    put together and sorted by time before windows are cut, so that windows do not depend on the
    batches' size; the source's rate limit bounds them.
    """

    def __init__(self, length: int, features: Sequence[str], ts: str):
        self.length, self.features, self.ts = length, list(features), ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        cells = ", ".join(f"`{f}` double" for f in self.features)
        self.rest = handle.getListState("rest", f"{cells}, target int")
        self.emitted = handle.getValueState("emitted", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        columns = [*self.features, "target"]
        fresh = [(c[self.ts].to_numpy(), c[columns].to_numpy(dtype=float)) for c in rows]
        order = np.argsort(np.concatenate([ts for ts, _ in fresh]), kind="stable")
        values = np.concatenate([v for _, v in fresh])[order]
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

    def close(self) -> None:
        pass


def count_windows(stream: DataFrame, key: str, ts: str, features: Sequence[str],
                  length: int = fv.WINDOW_LENGTH) -> DataFrame:
    """Windows of ``length`` rows per key on a live stream: ``(key, seq, y, features...)``."""
    schema = T.StructType([T.StructField("key", stream.schema[key].dataType),
                           T.StructField("seq", T.LongType()), T.StructField("y", T.IntegerType()),
                           *[T.StructField(f, T.ArrayType(T.DoubleType())) for f in features]])
    rows = stream.select(key, ts, "target", *[F.col(f).cast("double").alias(f) for f in features])
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=CountWindowProcessor(length, features, ts), outputStructType=schema,
        outputMode="append", timeMode="none")
