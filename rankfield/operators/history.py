"""Point-in-time history: what was known of a key strictly before each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def day_number(date: str) -> Column:
    """Days since 1970, for range frames over dates."""
    return F.datediff(F.col(date), F.lit(EPOCH))


def rolling_history(rows: DataFrame, key: str, date: str, spans: dict[str, int], measures: dict[str, Column]) -> DataFrame:
    """``rows`` with sums of ``measures`` over the same key in [date - days, date), for each span (suffix: days).

    A range frame on the day number excludes the day itself and anything later, so no row sees
    its own day. First days are aggregated per (key, day), so many rows of a key on one day are
    reduced before the window; all spans share one shuffle and one sort, and the daily sums are
    joined back once. A row without a key or a date stays, with zeros.
    """
    daily = rows.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key, date).agg(*[F.sum(value).alias(f"_{name}") for name, value in measures.items()])
    by_day = Window.partitionBy(key).orderBy(day_number(date))
    named = [(f"{name}{suffix}", F.sum(f"_{name}").over(by_day.rangeBetween(-days, -1))) for suffix, days in spans.items() for name in measures]
    joined = rows.join(daily.select(key, date, *[value.alias(name) for name, value in named]), [key, date], "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(0)) for name, _ in named})


def lookback(targets: DataFrame, history: DataFrame, key: str, date: str, days: int, measures: dict[str, Column]) -> DataFrame:
    """Aggregates of ``history`` in [date - days, date) for each (key, date) of ``targets``; those without history are absent.

    The range condition rides on an equi-join by (key, bucket of days): a target looks at its own
    bucket and the one before, so a key with a long history is never compared with all of it.
    """
    bucket = lambda d: F.floor(d / F.lit(days))
    wanted = targets.select(key, date).distinct().withColumn("_day", day_number(date))
    wanted = wanted.withColumn("_bucket", F.explode(F.array(bucket(F.col("_day")), bucket(F.col("_day")) - 1)))
    past = history.withColumn("_past_day", day_number(date)).withColumn("_bucket", bucket(F.col("_past_day"))).drop(date)
    joined = wanted.join(past, [key, "_bucket"]).filter((F.col("_past_day") < F.col("_day")) & (F.col("_past_day") >= F.col("_day") - days))
    return joined.groupBy(key, date).agg(*[value.alias(name) for name, value in measures.items()])


def latest_before(targets: DataFrame, versions: DataFrame, key: str, at: str, stamp: str, order: list[Column]) -> DataFrame:
    """Backward as-of join: for each target the version of its key with the greatest ``stamp`` <= ``at``.

    Union of both sides, one shuffle by key, and a running last value; ties of ``stamp`` go to the
    first by ``order``. Targets without an earlier version keep null columns.
    """
    columns = [c for c in versions.columns if c != key]
    first = Window.partitionBy(key, stamp).orderBy(*order)
    single = versions.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    left = targets.select("*", F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(single.select(F.struct(*columns)).schema[0].dataType).alias("_version"))
    right = single.select(key, F.col(stamp).alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_version"))
    both = left.unionByName(right, allowMissingColumns=True)
    running = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_version", F.last("_version", ignorenulls=True).over(running)).filter("_side = 1")
    return found.select(*targets.columns, *[F.col(f"_version.{c}").alias(c) for c in columns if c not in targets.columns])


def guarded(value: Column, created: Column, as_of: Column) -> Column:
    """``value`` if it was created by ``as_of``, else null."""
    return F.when(created <= as_of, value)
