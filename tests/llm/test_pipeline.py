"""The pipeline's stages, and the registered queries at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logharbor.llm import queries
from logharbor.llm.jaccard import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(5).selectExpr("NULL AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(docs.limit(3)).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert None not in ids and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        assert all(texts[r.doc_id] == r.text for r in docs.collect())
        if name == "n-gram jaccard join":
            groups = {r.component_id for r in jaccard_components(before).collect()}
            assert sorted(ids) == sorted(groups)
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in texts[d] for d in ids for i in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids)


@pytest.mark.parametrize("name", sorted([*queries.QUERIES, "pipeline"]))
def test_registered(spark, name):
    rows = entry.queries()[name](spark, SF)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
