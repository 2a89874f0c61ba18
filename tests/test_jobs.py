"""A detector kept and loaded again, and the jobs on a small store."""

import pytest
from pyspark.sql import functions as F

from flowlens import __main__ as jobs
from flowlens.operators.model_store import Detector, fit_detector
from flowlens.sources.feature_store import FeatureStore
from flowlens.streaming import live

FEATURES = ["f1", "f2"]


@pytest.fixture(scope="module")
def windows(spark):
    rows = []
    for split, n in (("train", 120), ("val", 20), ("test", 20)):
        for i in range(n):
            y = int(i % 4 == 0)
            rows.append((0, split, i, y, [3.0 * y + (i * 7 + j) % 5 * 0.3 for j in range(10)], [float((i + j) % 3) for j in range(10)]))
    return spark.createDataFrame(rows, "day int, split string, seq long, y int, f1 array<double>, f2 array<double>")


@pytest.mark.parametrize("name,fit_on", [("Logistic", "store"), ("XGBoost", "balanced")])
def test_a_loaded_detector_scores_alike(spark, windows, tmp_path, name, fit_on):
    fitted = fit_detector(windows, FEATURES, name, fit_on=fit_on, rounds=6)
    fitted.save(str(tmp_path / "m"))
    loaded = Detector.load(spark, str(tmp_path / "m"))
    assert loaded.settings == fitted.settings
    of = lambda d: {(r.split, r.seq): r.p for r in d.score(windows).collect()}
    assert of(loaded) == of(fitted) and len(of(fitted)) == 160
    hit = loaded.score(windows.where("split = 'test'")).groupBy("y").agg(F.avg("p").alias("p"))
    p = {r.y: r.p for r in hit.collect()}
    assert p[1] > p[0]


def test_a_loaded_detector_serves_a_stream(spark, windows, tmp_path):
    fit_detector(windows, FEATURES, "Logistic").save(str(tmp_path / "m"))
    d = Detector.load(spark, str(tmp_path / "m"))
    body = F.to_json(F.struct(F.transform(F.arrays_zip("f1", "f2"), lambda r: F.array(r["f1"], r["f2"])).alias("features")))
    test = windows.where("split = 'test'")
    test.select("seq", body.alias("value")).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("seq long, value string").parquet(str(tmp_path / "in"))
    good, _ = live.score_requests(stream, d.settings.features, d.settings.length, d.params, d.model, d.settings.threshold,
                                  clip=d.settings.clip)
    live.run_once(good, str(tmp_path / "ck"), lambda df, _: got.extend(df.collect())).awaitTermination()
    want = {r.seq: r.p for r in d.score(test).collect()}
    assert {r.seq: r.p for r in got} == pytest.approx(want)


def test_jobs_fit_and_detect(spark, windows, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "get_session", lambda: spark)
    store, model, out = (str(tmp_path / n) for n in ("store", "model", "out"))
    FeatureStore(spark, store).save(windows, FEATURES, 10)
    jobs.main(["fit", "--store", store, "--model", model, "--name", "Logistic"])
    jobs.main(["detect", "--store", store, "--model", model, "--out", out])
    assert spark.read.parquet(out).count() == 160
    jobs.main(["benchmark", "--store", store, "--out", out, "--tabular", "Logistic", "--sequence"])
    assert spark.read.option("header", "true").csv(f"{out}/matrix").count() == 1
    with pytest.raises(SystemExit):
        jobs.main(["unknown"])
