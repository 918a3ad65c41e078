"""The subpackage's queries against their SQL, and the pipeline against what each stage promises."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert not differences(df, con, ORACLES[name])
    else:
        table = "pages" if name.startswith("op3") else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"size": F.lit("x"), "digest": F.lit(1)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns, name
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        after = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after)) and len(after) > len(before) / 2, name
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ["shard", "part", "order", "doc_id", "epoch", "word_from", "text"] == last.columns
    words = lambda df: df.agg(F.sum(F.size(F.split("text", " +"))).alias("n")).first()["n"]
    assert words(last) > 0 and {r["doc_id"] for r in last.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_with_null_ids_repeats_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    row = docs.first().asDict()
    long = " ".join(f"w{i % 7000}x{i // 7000}" for i in range(20_000))
    odd = spark.createDataFrame([{**row, **x} for x in (
        {"doc_id": None, "text": "no id " + row["text"]}, {"doc_id": None, "text": None}, {"doc_id": 10**9, "text": long}, {"doc_id": 10**9, "text": long},
        {"doc_id": 10**9 + 1, "text": ""}, {"doc_id": 10**9 + 2, "source": None})], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= docs.count(), name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(10**9) <= 1 and len(ids) > 30
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_pipelines_leave_other_queries_alone(spark):
    """Lazy frames made before and between two pipelines are still there to be read."""
    rules, chat = QUERIES["op7_quality_rules"](spark, SF), QUERIES["op13_token_alignment"](spark, SF)
    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    assert rules.count() == chat.count() == 200
    assert first.count() == second.count() > 0


def test_pipeline_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
