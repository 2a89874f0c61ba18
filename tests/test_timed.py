"""Keyed operators in event time: order over batches, late rows, expiry, bounded state."""

import datetime as dt
import random

import pytest

from flowlens import fixed_values as fv
from flowlens.streaming import keyed, live, timed

T0 = dt.datetime(2024, 1, 1)
FLOWS = "k string, ts timestamp, id bigint, target int, f double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def setting(spark):
    live.use_rocksdb(spark)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def write_rows(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, checkpoint, mode="append"):
    rows = []
    q = live.run_once(stream, checkpoint, lambda batch, _: rows.extend(batch.collect()), mode)
    q.awaitTermination()
    return rows, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def windows_of(rows, length=10):
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    return [(i // length, [r[4] for r in rows[i:i + length]]) for i in range(0, len(rows) // length * length, length)]


def test_windows_are_those_of_the_sorted_rows(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    pick = random.Random(3)
    rows = [(k, at(i // 2), i, 0, float(i)) for k in "ab" for i in range(237)]
    # each comes up to 20 s late, so rows of one batch belong before rows of the one before
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=pick.uniform(0, 20)))
    got = []
    for part in range(4):
        write_rows(spark, order[part * 120:(part + 1) * 120], FLOWS, src)
        stream = live.with_event_time(spark.readStream.schema(FLOWS).parquet(src), delay="20 seconds")
        out, _ = run(timed.timed_windows(stream, "k", "ts", ["f"], ["id"], bucket_ms=4000), ck)
        got += out
    write_rows(spark, [("c", at(100_000), 0, 0, 0.0)], FLOWS, src)
    out, held = run(timed.timed_windows(live.with_event_time(spark.readStream.schema(FLOWS).parquet(src), delay="20 seconds"),
                                        "k", "ts", ["f"], ["id"], bucket_ms=4000), ck)
    got += out
    for k in "ab":
        assert sorted((r.seq, r.f) for r in got if r.key == k) == windows_of([r for r in rows if r[0] == k])
    # 7 rows of an unfinished window and two numbers for each key, and what the last row needs: nothing else waits
    assert held <= 2 * (7 + 3) + 6


def test_late_rows_are_left_out_and_silent_keys_forgotten(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")

    def more(rows):
        write_rows(spark, rows, FLOWS, src)
        stream = live.with_event_time(spark.readStream.schema(FLOWS).parquet(src), delay="10 seconds")
        return run(timed.timed_windows(stream, "k", "ts", ["f"], ["id"], length=3, bucket_ms=1000, keep_ms=60_000), ck)

    more([("a", at(i), i, 0, float(i)) for i in range(5)])
    got, _ = more([("z", at(40), 0, 0, 0.0)])
    assert [(r.seq, r.f) for r in got] == [(0, [0.0, 1.0, 2.0])]
    got, _ = more([("a", at(2), 99, 0, 99.0), ("a", at(45), 5, 0, 5.0), ("z", at(80), 1, 0, 1.0)])
    assert [(r.key, r.seq, r.f) for r in got if r.key == "a"] == [("a", 1, [3.0, 4.0, 5.0])]
    more([("z", at(500), 2, 0, 2.0)])
    got, _ = more([("a", at(510), 6 + i, 0, 6.0 + i) for i in range(3)] + [("z", at(900), 3, 0, 3.0)])
    assert [(r.key, r.seq, r.f) for r in got if r.key == "a"] == [("a", 0, [6.0, 7.0, 8.0])]


INC = "src_ip string, ts timestamp, threat_id string"
ACT = "src_ip string, ts timestamp, action_id bigint, action string"


def test_actions_wait_for_incidents_and_expire(spark, tmp_path):
    inc, act, ck = (str(tmp_path / n) for n in ("inc", "act", "ck"))
    write_rows(spark, [("x", at(0), "MITRE-T1046")], INC, inc)

    def more(actions, incidents=()):
        write_rows(spark, actions, ACT, act)
        if incidents:
            write_rows(spark, list(incidents), INC, inc)
        both = keyed.incident_action_stream(spark.readStream.schema(INC).parquet(inc), spark.readStream.schema(ACT).parquet(act))
        out, held = run(timed.answer_timed_actions(live.with_event_time(both, delay="30 seconds"), bucket_ms=1000, keep_ms=120_000), ck)
        return {r.action_id: (r.found, r.status, r.rule) for r in out}, held

    # more actions than an Arrow batch has rows; that of 11 comes a batch before its incident
    got, _ = more([("a", at(11), 1, "report"), *(("a", at(12 + i % 3), 10 + i, "report") for i in range(17)), ("a", at(9), 2, "report")])
    assert got == {}
    got, _ = more([("a", at(20), 3, "block"), ("y", at(100), 90, "report")], [("a", at(10), "MITRE-T1498")])
    assert got[1] == (True, fv.STATUS_DETECTED, None) and got[2] == (False, None, None)
    assert got[3] == (True, fv.STATUS_BLOCKED, "iptables -A INPUT -s a -j DROP")
    assert all(got[10 + i] == (True, fv.STATUS_DETECTED, None) for i in range(17))
    got, _ = more([("a", at(5), 4, "report"), ("a", at(110), 5, "report"), ("y", at(200), 91, "report")])
    assert 4 not in got and got[5] == (True, fv.STATUS_BLOCKED, None)
    more([("y", at(1000), 92, "report")])
    got, held = more([("a", at(1001), 6, "report"), ("y", at(2000), 93, "report")])
    assert got[6] == (False, None, None)
    got, held = more([("y", at(9000), 94, "report")])
    assert held <= 12


def test_registry_forgets_silent_sources(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    held, known = [], {}
    for part in range(6):
        rows = [(f"once-{part}-{i}", at(part * 1000 + i), f"T{i}") for i in range(60)]
        rows += [("often", at(part * 1000 + i), f"T{part}-{i}") for i in (30, 5, 58, 12, 1, 40, 7)]
        write_rows(spark, rows, INC, src)
        stream = live.with_event_time(spark.readStream.schema(INC).parquet(src), delay="10 seconds")
        out, n = run(timed.expiring_registry(stream, keep_ms=1_500_000), ck, "update")
        known |= {r.src_ip: (r.threat_id, r.incidents) for r in out}
        held.append(n)
    assert known["often"] == ("T5-58", 42) and known["once-3-7"] == ("T7", 1)
    # 61 sources a batch, of which those of the last two or three batches are still known, each with its timer
    assert max(held) <= 3 * 61 * 3 and held[-1] <= max(held[:4])
