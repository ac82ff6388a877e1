"""Every query with SQL gives the rows that DuckDB gives; the flagship has a stable schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from rankfield.plans import ORACLE_SQL, QUERIES


def shown(row) -> str:
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "-"
        return f"{round(float(x), 6) + 0.0:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return "|".join(map(one, row))


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"create view {name[:-8]} as select * from read_parquet('{data}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, data, con, name):
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(shown, want)) == sorted(shown(tuple(r)) for r in found.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_no_query_sees_the_future(spark, data):
    """Moving all later results changes no history of an earlier event."""
    from pyspark.sql import functions as F

    from rankfield.plans.prediction import finished, with_history

    rows = finished(spark, data)
    cut = F.col("race_date") < "1997-01-01"
    changed = rows.withColumn("place", F.when(cut, F.col("place")).otherwise(99))
    columns = ["race_id", "entry_no", "starts", "wins", "top3", "starts_t", "wins_t", "top3_t"]
    before, after = (with_history(x).filter("race_date <= '1997-01-01'").select(*columns) for x in (rows, changed))
    assert before.exceptAll(after).count() == 0
