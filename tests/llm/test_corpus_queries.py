"""Registered corpus queries against their SQL, and the pipeline, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from annolytics.llm.oracle import LLM_ORACLE
from annolytics.llm.queries import LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = connection.execute(LLM_ORACLE[name])
    columns = [d[0] for d in cursor.description]
    found = LLM_QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, cursor.fetchall()))


def test_pipeline_stages_keep_columns_and_bins_hold_what_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    left = docs.selectExpr("count(*) n", "sum(length(text)) chars").first()
    assert 0 < left.n < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.selectExpr("sum(length)").first()[0] == left.chars
