"""Chronological splits: fractions, walk-forward folds, named windows, complete-date accumulation.

Positions are computed from per-date counts (one row per date), never by sorting all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Windows that may be broadcast to every row.
MOST_WINDOWS = 10_000


def positions(rows: DataFrame, date: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` from 0 by (date, order) and ``total``; rows without a date come last."""
    dates = rows.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(F.col(date).asc_nulls_last())) - F.col("_n")  # one row per date
    dates = dates.select(F.col(date).alias("_date"), upto.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy(date).orderBy(*order)) - 1
    joined = rows.join(F.broadcast(dates), F.col(date).eqNullSafe(F.col("_date")))
    return joined.withColumn("position", (F.col("_before") + inside).cast("long")).drop("_before", "_date")


def fraction_split(rows: DataFrame, date: str, order: list[str], train: float = 0.4, dev: float = 0.4) -> DataFrame:
    """``rows`` with ``split``: train, dev, test at int(n * share) boundaries in time."""
    placed = positions(rows, date, order)
    first, second = F.floor(F.col("total") * train), F.floor(F.col("total") * train) + F.floor(F.col("total") * dev)
    split = F.when(F.col("position") < first, "train").when(F.col("position") < second, "dev").otherwise("test")
    return placed.withColumn("split", split).drop("position", "total")


def walk_forward(rows: DataFrame, date: str, order: list[str], folds: int) -> DataFrame:
    """(row, fold, split): expanding folds; the last takes the remainder, the last quarter of a prefix validates."""
    placed = positions(rows, date, order)
    size = F.greatest(F.lit(1), F.floor(F.col("total") / (folds + 1)))
    each = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("_start", size * F.col("fold"))
    end = F.when(F.col("fold") == folds, F.col("total")).otherwise(F.col("_start") + size)
    train_end = F.col("_start") - F.greatest(F.lit(1), F.floor(F.col("_start") / 4))
    split = F.when(F.col("position") < train_end, "train").when(F.col("position") < F.col("_start"), "dev").when(F.col("position") < end, "test")
    return each.withColumn("split", split).filter("split is not null").drop("position", "total", "_start")


def window_membership(rows: DataFrame, date: str, windows: DataFrame) -> DataFrame:
    """(row, window, split) for named windows (name, train_end, eval_start, eval_end); a row may be in several.

    Windows are configuration, a handful of rows, so the range join broadcasts them; more than
    MOST_WINDOWS are refused.
    """
    if windows.count() > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    train = F.col(date) <= F.col("train_end")
    evaluated = F.col(date).between(F.col("eval_start"), F.col("eval_end"))
    joined = rows.join(F.broadcast(windows), train | evaluated)
    return joined.withColumn("split", F.when(train, "train").otherwise("eval")).drop("train_end", "eval_start", "eval_end")


def newest_complete_dates(rows: DataFrame, date: str, included: str, least: int) -> DataFrame:
    """Dates, newest first, all of whose rows are included, until they hold ``least`` rows."""
    dates = rows.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.min(F.col(included).cast("int")).alias("_all")).filter("_all = 1")
    newer = F.sum("n").over(Window.orderBy(F.desc(date))) - F.col("n")  # one row per date
    return dates.withColumn("newer", newer).filter(F.col("newer") < least).select(date, "n", "newer")


def holdout_plan(rows: DataFrame, date: str, included: str, sets: list[tuple[str, int]]) -> DataFrame:
    """``rows`` of complete dates with ``dataset``: the newest dates that hold the first set's least number of rows, then those before them for the next.

    A date is complete if all its rows are included; incomplete ones are passed over, and no date is
    in two sets. Too few rows for a set are an error. Windows and the broadcast hold one row per date.
    """
    dates = rows.groupBy(date).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col(included).cast("int")).alias("_all")).filter("_all = 1")
    dates = dates.withColumn("_upto", F.sum("_n").over(Window.orderBy(F.desc(date)))).withColumn("_newer", F.col("_upto") - F.col("_n"))
    begun, dataset = F.lit(0).cast("long"), F.lit(None).cast("string")
    for i, (name, least) in enumerate(sets):
        dates = dates.withColumn(f"_end{i}", F.min(F.when(F.col("_upto") >= begun + least, F.col("_upto"))).over(Window.partitionBy()))
        end = F.coalesce(F.col(f"_end{i}"), F.raise_error(F.lit(f"too few rows of complete dates for {name}")).cast("long"))
        dataset = F.when((F.col("_newer") >= begun) & (F.col("_newer") < end), name).otherwise(dataset)
        begun = end
    chosen = dates.select(date, dataset.alias("dataset")).filter("dataset IS NOT NULL")
    return rows.join(F.broadcast(chosen), date)


def plan_manifest(planned: DataFrame, key: str, date: str) -> DataFrame:
    """(dataset, races, dates, first_day, last_day, digest) of a plan; the digest is a sum over ids, so it does not depend on their order."""
    word = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return planned.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("races"), F.count_distinct(date).alias("dates"), F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.sum(word).cast("string").alias("digest")
    )
