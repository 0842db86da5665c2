import os

import pytest

import corpus_pipeline
from hexlytics.llm import registry
from hexlytics.llm import queries  # noqa: F401

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "secrets", "mixture", "packing"]


@needs_tables
def test_each_stage_decides(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        docs = docs.cache()
        counts.append(docs.count())
    start, good, single, safe, mixed = counts
    assert 0 < single < good < start and safe == single and mixed > safe
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {
        r[0] for r in docs.select("doc_id").distinct().collect()}


def test_empty_and_odd_documents(spark, docs, folder):
    path = folder("odd")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    for rows in ([], [(None, None, None), (1, "", None), (1, "", None), (2, "a b c d e f", "x")]):
        df = docs(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, path)
            assert df.columns == docs([]).columns
        assert corpus_pipeline.pack_sequences(spark, df, path).count() >= bool(rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.EXPECTED))
def test_query_agrees_with_sql(spark, name):
    from workload.check import connect, differences

    found = registry.QUERIES[name](spark, SF_DIR)
    assert differences(found, connect(SF_DIR), registry.EXPECTED[name]) == []


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))
