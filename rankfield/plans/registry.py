"""Registered queries: name -> (query, equivalent DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where one exists.

    Columns named in ``dates`` (dates and times) leave as ISO text on both sides, which every client reads alike.
    """

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = function(spark, sf_dir)
            return found.withColumns({c: found[c].cast("string") for c in dates}) if dates else found

        QUERIES[function.__name__] = run
        if sql is not None:
            shown = ", ".join(f"{c}::VARCHAR AS {c}" for c in dates)
            ORACLE_SQL[function.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if dates else sql
        return function

    return register
