"""Every registered query against its SQL, exact in types and values."""

import pytest

import oracle
from flowlens.plans import load_queries

QUERIES = load_queries()
CHECKED = [n for n, q in QUERIES.items() if q.sql is not None]
# These fit hundreds of rounds each; the comparison below fits all of them once.
LONG = ("train_test_gaps", "train_candidates", "boosted_xgboost", "boosted_lightgbm")
UNCHECKED = [n for n, q in QUERIES.items() if q.sql is None and n not in LONG]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    q = QUERIES[name]
    assert oracle.differences(q.run(spark, sf_dir), con, q.sql) is None


@pytest.mark.parametrize("name", UNCHECKED)
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


@pytest.mark.parametrize("name,columns", [
    ("flow_detections", ("detected", "hits")), ("batch_audit", ("tp", "fp", "tn"))])
def test_no_verdict_is_constant(spark, sf_dir, name, columns):
    rows = QUERIES[name].run(spark, sf_dir).collect()
    assert all(sum(r[c] for r in rows) > 0 for c in columns)
    if name == "flow_detections":
        assert 0.05 <= sum(r.detected for r in rows) / sum(r.windows for r in rows) <= 0.5


def test_gaps_cover_every_model(spark, sf_dir):
    from flowlens import fixed_values as fv
    from flowlens.operators.models import BUILDERS, SEQUENCE_SETTINGS
    found = {r.model for r in QUERIES["train_test_gaps"].run(spark, sf_dir).collect()}
    assert found == {*BUILDERS, *SEQUENCE_SETTINGS, fv.ENSEMBLE_NAME}


def test_actions_meet_and_miss_incidents(spark, sf_dir):
    assert {r.found for r in QUERIES["action_join"].run(spark, sf_dir).select("found").distinct().collect()} == {True, False}
    assert QUERIES["root_cause"].run(spark, sf_dir).count() > 0


def test_explanations_match_several_threats(spark, sf_dir):
    found = QUERIES["explained_threats"].run(spark, sf_dir).collect()
    assert any(r.matched for r in found) and len({r.threat_id for r in found if r.matched}) > 1


def test_blended_retrieval_tells_threats_apart(spark, sf_dir):
    found = QUERIES["hybrid_explained"].run(spark, sf_dir).collect()
    assert len({r.threat_id for r in found if r.matched}) > 1 and len({r.hybrid_score for r in found}) > 1


def test_entry_points(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
