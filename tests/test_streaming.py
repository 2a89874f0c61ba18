"""Streams from files, driven with availableNow; restarts go on from the checkpoint."""

import datetime as dt
import random
import os

import pytest
from pyspark.sql import functions as F

from flowlens import fixed_values as fv
from flowlens.operators import models
from flowlens.sources.tables import table
from flowlens.streaming import keyed, live


@pytest.fixture(autouse=True)
def rocksdb(spark):
    live.use_rocksdb(spark)


def drain(stream, name, checkpoint, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.table(name)


def collect_to(rows):
    def sink(batch, _):
        rows.extend(batch.collect())
    return sink


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def test_daily_counts_match_batch(spark, sf_dir, tmp_path):
    out = drain(live.daily_counts(event_stream(spark, sf_dir), "event_type"), "daily",
                str(tmp_path / "c"), "update")
    got = {(r.day, r.event_type): r.rows for r in out.collect()}
    want = {(r.day, r.event_type): r["count"] for r in table(spark, sf_dir, "events").groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").count().collect()}
    assert got == want


def test_registry_last_write_wins(spark, sf_dir, tmp_path):
    s = event_stream(spark, sf_dir).where("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("src_ip"), F.col("ts").cast("timestamp").alias("ts"),
        "event_id")
    out = drain(live.live_registry(s), "registry", str(tmp_path / "c"), "complete")
    got = {r.src_ip: (r.incident.event_id, r.incidents) for r in out.collect()}
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").collect()
    want = {}
    for r in sorted(rows, key=lambda r: r.ts):
        want[str(r.user_id)] = (r.event_id, want.get(str(r.user_id), (0, 0))[1] + 1)
    assert got == want


def write_rows(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


INC = "src_ip string, ts timestamp, threat_id string"
ACT = "src_ip string, ts timestamp, action_id bigint, action string"


def test_actions_follow_time_and_survive_restart(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    inc, act, ck = (str(tmp_path / n) for n in ("inc", "act", "ck"))
    write_rows(spark, [("a_b", t(5), "MITRE-T1046")], INC, inc)
    write_rows(spark, [("a_b", t(1), 1, "report"), ("a_b", t(6), 2, "block"),
                       ("a_b", t(7), 3, "report"), ("z", t(2), 4, "block")], ACT, act)

    def run(rows):
        both = keyed.incident_action_stream(spark.readStream.schema(INC).parquet(inc),
                                            spark.readStream.schema(ACT).parquet(act))
        live.run_once(keyed.answer_actions(both), ck, collect_to(rows)).awaitTermination()
        return {r.action_id: (r.found, r.status, r.rule) for r in rows}

    got = run([])
    assert got[1] == (False, None, None)
    assert got[2] == (True, fv.STATUS_BLOCKED, "iptables -A INPUT -s a_b -j DROP")
    assert got[3] == (True, fv.STATUS_BLOCKED, None)
    assert got[4] == (False, None, "iptables -A INPUT -s z -j DROP")
    write_rows(spark, [("a_b", t(20), 5, "report")], ACT, act)
    assert run([]) == {5: (True, fv.STATUS_BLOCKED, None)}
    write_rows(spark, [("a_b", t(30), "MITRE-T1498")], INC, inc)
    write_rows(spark, [("a_b", t(31), 6, "ignore")], ACT, act)
    assert run([]) == {6: (True, fv.STATUS_DETECTED, None)}


def test_count_windows_do_not_depend_on_arrow_batches(spark, tmp_path):
    """Shuffled rows of one key in batches of five give the windows of the sorted rows."""
    src, schema = str(tmp_path / "src"), "k string, ts timestamp, target int, f double"
    t0, order = dt.datetime(2024, 1, 1), list(range(203))
    random.Random(3).shuffle(order)
    write_rows(spark, [("a", t0 + dt.timedelta(seconds=i), 0, float(i)) for i in order], schema, src)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = []
        s = spark.readStream.schema(schema).parquet(src)
        live.run_once(keyed.count_windows(s, "k", "ts", ["f"]), str(tmp_path / "ck"),
                      collect_to(got)).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted((r.seq, r.f) for r in got) == [
        (w, [float(i) for i in range(10 * w, 10 * w + 10)]) for w in range(20)]


def test_count_windows_carry_over(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    schema = "k string, ts timestamp, target int, f double"
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=i), int(i < 2), float(i)) for i in range(37)]

    def run():
        got = []
        s = spark.readStream.schema(schema).parquet(src)
        live.run_once(keyed.count_windows(s, "k", "ts", ["f"]), ck,
                      collect_to(got)).awaitTermination()
        return sorted((r.seq, r.y, r.f) for r in got)

    write_rows(spark, rows[:25], schema, src)
    first = run()
    assert [(s, y) for s, y, _ in first] == [(0, 1), (1, 0)]
    assert first[1][2] == [float(i) for i in range(10, 20)]
    write_rows(spark, rows[25:], schema, src)
    assert [(s, f) for s, _, f in run()] == [(2, [float(i) for i in range(20, 30)])]


def test_incident_numbers_go_on_and_repeat(spark, tmp_path):
    path = str(tmp_path / "counts")
    t0 = dt.datetime(2024, 1, 1)
    def frame(n, at):
        return spark.createDataFrame([(i, t0 + dt.timedelta(minutes=at + i)) for i in range(n)],
                                     "id bigint, ts timestamp").withColumn(
            "day", F.date_format("ts", "yyyy-MM-dd"))
    def ids(n, at, batch):
        return sorted(r.incident_id for r in live.number_batch(
            frame(n, at), batch, path, "day", "ts", ["id"]).collect())
    assert ids(3, 0, 0)[-1] == "INC-2026-NIDS-00003"
    assert ids(2, 10, 1) == ["INC-2026-NIDS-00004", "INC-2026-NIDS-00005"]
    assert ids(2, 10, 1) == ["INC-2026-NIDS-00004", "INC-2026-NIDS-00005"]


def test_alerts_of_a_repeated_batch_are_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "incident_id string")
    path = str(tmp_path / "alerts")
    write = live.alert_writer(path)
    write(df, 0); write(df, 0); write(df.limit(1), 1)
    assert spark.read.parquet(path).count() == 3
    blocked = tmp_path / "file"
    blocked.write_text("x")
    from flowlens.sources.sinks import append_alerts
    with pytest.raises(Exception):
        append_alerts(df, str(blocked), 0, pause=0.0)


def test_score_stream_with_counters(spark, tmp_path):
    feats = ["f1", "f2"]
    train = spark.createDataFrame(
        [(0, s, i, int(i % 3 == 0), [float(i % 3 == 0) * 3 + j * .1 for j in range(10)],
          [1.0 * j for j in range(10)]) for s in ["train"] for i in range(60)],
        "day int, split string, seq long, y int, f1 array<double>, f2 array<double>")
    from flowlens.operators.windows import window_table_stats
    stats = window_table_stats(train, feats)
    model, _ = models.fit_tabular("Logistic", stats, feats, rounds=20)
    params = {"f1": (0.0, 1.0), "f2": (0.0, 1.0)}
    src = str(tmp_path / "src")
    os.makedirs(src)
    hot = [[3 + j * .1, 1.0 * j] for j in range(10)]
    cold = [[j * .1, 1.0 * j] for j in range(10)]
    import json
    with open(os.path.join(src, "r.txt"), "w") as f:
        f.write(json.dumps({"features": hot, "src_ip": "10.0.0.9"}) + "\n")
        f.write(json.dumps({"features": cold}) + "\n")
        f.write(json.dumps({"features": hot[:9]}) + "\n")
        f.write('{"features": "x"}\nnot json\n')
    stream = spark.readStream.schema("value string").text(src)
    good, bad = live.score_requests(stream, feats, 10, params, model, threshold=0.5)
    got = drain(good, "scored", str(tmp_path / "c1")).collect()
    assert {(r.src_ip, r.is_threat, r.verdict) for r in got} == {
        ("10.0.0.9", True, None), ("unknown", False, "BENIGN")}
    assert drain(bad, "rejected", str(tmp_path / "c2")).count() == 3
    n = drain(live.live_counters(good), "counters", str(tmp_path / "c3"), "complete").first()
    assert (n.windows, n.threats) == (2, 1)
