"""Every stage keeps the columns of documents and takes effect; queries match their SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from rankfield.llm import simhash
from rankfield.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == COLUMNS
        docs = corpus_pipeline.staged(out, "stage-test")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= docs.count()


def test_dedup_leaves_single_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = simhash.keep_one(docs)
    again = simhash.near_duplicates(kept).filter("doc_id <> component_id").count()
    assert again == 0 and kept.count() < docs.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    rows = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    found = QUERIES[name](spark, data).select(*columns).collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in found)
