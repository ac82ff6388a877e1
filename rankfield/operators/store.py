"""Keyed tables on plain Parquet: upserts, keep-latest, retention, deduplication, anti-joins.

Parquet has no transactions: an upsert builds the new version of the table, which the writer then
swaps in as a whole (write to a new folder, then switch readers), so readers see the old or the
new version. Partition the table by date to rewrite only the partitions that changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_latest(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row per key, the first in the given order; the rank filter is applied before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with rows of ``incoming`` replacing or joining it by key."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return keep_latest(both, keys, F.desc("_new"), *[F.asc(c) for c in current.columns]).drop("_new")


def upsert_unless(current: DataFrame, incoming: DataFrame, keys: list[str], final: Column) -> DataFrame:
    """As upsert, but rows of ``current`` for which ``final`` holds are never replaced."""
    locked = current.filter(final).select(*keys).distinct()
    return upsert(current, incoming.join(locked, keys, "left_anti"), keys)


def retained(rows: DataFrame, date: str, cutoff: Column) -> DataFrame:
    """Rows on or after the cutoff; on a table partitioned by ``date`` only those partitions are read."""
    return rows.filter(F.col(date) >= cutoff)


def month_cutoff(today: Column, keep_months: int) -> Column:
    """First day of the month, keep_months - 1 months back."""
    return F.add_months(F.trunc(today, "month"), 1 - keep_months)


def filled(value: Column, kind: T.DataType) -> Column:
    """How many leaves of a value are filled, at any depth; null, blank text, NaN and infinite numbers are not."""
    if isinstance(kind, T.StructType):
        parts = [filled(value[f.name], f.dataType) for f in kind.fields]
        return F.when(value.isNotNull(), reduce(lambda a, b: a + b, parts, F.lit(0))).otherwise(0)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        items, of = (value, kind.elementType) if isinstance(kind, T.ArrayType) else (F.map_values(value), kind.valueType)
        return F.coalesce(F.aggregate(items, F.lit(0), lambda n, x: n + filled(x, of)), F.lit(0))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        present = ~F.isnan(value) & (F.abs(value) != float("inf"))
    else:
        present = F.trim(value.cast("string")) != "" if isinstance(kind, T.StringType) else value.isNotNull()
    return F.coalesce(present.cast("int"), F.lit(0))


def filled_fields(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """How many leaves of the columns are filled."""
    return reduce(lambda a, b: a + b, [filled(F.col(c), rows.schema[c].dataType) for c in columns or rows.columns], F.lit(0))


def stable(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs in the order of their names, at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[stable(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: stable(x, kind.elementType))
    return value


def canonical_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deduplicate by key: the row with the most filled leaves stays, ties go to the smallest JSON text.

    An aggregation with partial results, so copies of a frequent key never meet in one task.
    """
    whole = F.struct(*rows.columns)
    text = F.to_json(stable(whole, rows.schema))
    best = F.min_by(whole, F.struct((-filled_fields(rows)).alias("n"), text.alias("text")))
    return rows.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def truthy(c: Column) -> Column:
    """1 for a value that is present, not blank and not 0."""
    number = c.cast("string").try_cast("double")
    return F.coalesce(((F.trim(c.cast("string")) != "") & F.coalesce(number != 0, F.lit(True))).cast("int"), F.lit(0))
