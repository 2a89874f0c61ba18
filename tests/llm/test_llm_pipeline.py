"""The pipeline stage by stage, and the registered queries."""

import pytest

import corpus_pipeline
import oracle
from flowlens.llm import decontaminate, near_copies, quality_model, quality_rules
from flowlens.llm.queries import ORACLE_SQL, QUERIES

from .helpers import awkward_rows, docs_of, rows_of


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs_of(spark, awkward_rows(), extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (100, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, awkward_rows()[2][1][:200])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_do_what_their_operators_say(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels, bench = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    decisions = [lambda d: {r.doc_id for r in quality_model.classify_quality(d, labels).where("kept").collect()},
                 lambda d: {r.doc_id for r in quality_rules.apply_rules(d).where("kept").collect()},
                 lambda d: {r.component_id for r in near_copies.near_copies(d).collect()},
                 lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in decontaminate.find_leaks(d, bench).collect()}]
    texts = {r.doc_id: tuple(r) for r in docs.collect()}
    for (name, step), decide in zip(corpus_pipeline.STAGES, decisions):
        out = step(spark, docs, big)
        kept = out.collect()
        assert {r.doc_id for r in kept} == decide(docs) and len(kept) == len({r.doc_id for r in kept}), name
        assert out.columns == docs.columns and all(tuple(r) == texts[r.doc_id] for r in kept)
        docs = spark.createDataFrame(kept, docs.schema)
    assert docs.count() > 500
    last = corpus_pipeline.STAGES[-1][1](spark, docs, big)
    assert rows_of(last.select("doc_id")) == rows_of(docs.select("doc_id"))
    assert rows_of(corpus_pipeline.run(spark, big)) == rows_of(last)


def test_pipeline_takes_awkward_and_empty_tables(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    big = sf_dir.replace("sf0.001", "sf0.01")
    assert oracle.differences(QUERIES[name](spark, big), oracle.connect(big), ORACLE_SQL[name]) is None


def test_every_operator_has_a_query_over_its_table(spark, sf_dir):
    import __spark_entry__
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))
    assert set(__spark_entry__.queries()) >= {"pipeline", *QUERIES}
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op1_main_text", "op3_token_counts", "op4_quality_rules", "op5_mix_sources", "op6_simhash_dedup",
                 "op7_quality_model", "op8_toxicity", "op9_kneser_ney", "op12_personal_data"):
        assert QUERIES[name](spark, sf_dir).count() == n["pages" if name == "op1_main_text" else "documents"], name
