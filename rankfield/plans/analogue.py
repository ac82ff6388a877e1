"""Events with competing entries, read from the order tables.

An order is an event, its lines are the entries (place in line order = entry number and position), part
and supplier are the entry's horse-like and rider-like keys. ``ENTRIES_SQL`` and ``EVENTS_SQL``
define the same rows for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.sources.tables import table


#: Line numbers repeat within an order, so an entry's number is its place in this total order.
POSITION = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_id, race_date, meet, status."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("race_id"),
        F.to_date("o_orderdate").alias("race_date"),
        (F.col("o_custkey") % 3 + 1).cast("int").alias("meet"),
        F.col("o_orderstatus").alias("status"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry, with its event's date and meet; rows leave partitioned and sorted by event.

    The key is renamed before the window, so that the join and later windows by event know the order and shuffle nothing again.
    """
    place = F.row_number().over(Window.partitionBy("race_id").orderBy(*POSITION))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "race_id").withColumn("pos", place).select(
        "race_id",
        "pos",
        F.col("pos").alias("entry_no"),
        F.col("l_partkey").alias("horse_id"),
        F.col("l_suppkey").alias("rider_id"),
        F.when(F.col("l_tax") > 0, F.floor(F.col("l_extendedprice") / 100) / 10).alias("win_odds"),
        (F.col("l_quantity") * 3).alias("rating"),
        (F.col("l_quantity") + 20).alias("burden"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )
    return lines.join(events(spark, sf_dir), "race_id")


EVENTS_SQL = """
    events_v AS (
        SELECT o_orderkey AS race_id, o_orderdate::DATE AS race_date, (o_custkey % 3 + 1)::INT AS meet, o_orderstatus AS status FROM orders)"""

ENTRIES_SQL = (
    EVENTS_SQL
    + f""",
    lines_v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(POSITION)}) AS place_v FROM lineitem),
    entries_v AS (
        SELECT l_orderkey AS race_id, place_v AS pos, place_v AS entry_no, l_partkey AS horse_id, l_suppkey AS rider_id,
            CASE WHEN l_tax > 0 THEN floor(l_extendedprice / 100) / 10 END AS win_odds, l_quantity * 3 AS rating, l_quantity + 20 AS burden,
            l_discount AS discount, l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS line_status, race_date, meet, status
        FROM lines_v JOIN events_v ON l_orderkey = race_id)"""
)
