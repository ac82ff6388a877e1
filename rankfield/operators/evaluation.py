"""Metrics of ranked predictions against results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(predicted: Column, actual: Column, k: int = 3) -> Column:
    """Distinct items that the first k of both lists share."""
    return F.size(F.array_intersect(F.slice(predicted, 1, k), F.slice(actual, 1, k)))


def set_match(predicted: Column, actual: Column, k: int = 3) -> Column:
    """hits / k, whatever the number of actual items; 0 where there are none."""
    return F.coalesce(hits(predicted, actual, k) / F.lit(k), F.lit(0.0))


def ndcg(predicted: Column, actual: Column, k: int = 3) -> Column:
    """NDCG at k with relevance k, k-1, ... by actual position; repeated predictions count again."""
    relevance = F.transform(
        F.slice(predicted, 1, k),
        lambda p: F.when(F.array_contains(F.slice(actual, 1, k), p), F.lit(k + 1) - F.array_position(F.slice(actual, 1, k), p)).otherwise(0),
    )
    gain = F.aggregate(
        F.transform(relevance, lambda r, i: r / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x
    )
    ideal = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.least(F.size(actual), F.lit(k)) - 1), lambda i: (k - i) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x
    )
    return F.when((F.size(predicted) > 0) & (F.size(actual) > 0), gain / ideal).otherwise(0.0)


def probability(confidence: Column, least: float = 1e-6) -> Column:
    """A confidence as a probability: 50 if missing, percent above 1, clipped away from 0 and 1."""
    value = F.coalesce(confidence.cast("double"), F.lit(50.0))
    value = F.when(value > 1, value / 100).otherwise(value)
    return F.least(F.greatest(value, F.lit(least)), F.lit(1 - least))


def log_loss(y: Column, p: Column) -> Column:
    """Mean binary cross entropy, 0 over no rows."""
    return F.coalesce(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), F.lit(0.0))


def brier(y: Column, p: Column) -> Column:
    """Mean squared error of probabilities, 0 over no rows."""
    return F.coalesce(F.avg((p - y) * (p - y)), F.lit(0.0))


def calibration_bins(rows: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """(bin, n, accuracy, confidence) of equal-width bins; the last bin is closed."""
    which = F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1))
    return rows.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("accuracy"), F.avg(p).alias("confidence"))


def expected_calibration_error(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row (ece): bin-weighted absolute gap of accuracy and confidence."""
    by_bin = calibration_bins(rows, y, p, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")
    return by_bin.agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def reliability_diagram(rows: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """All bins, empty ones with n = 0."""
    spark = rows.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    found = calibration_bins(rows, y, p, bins)
    return every.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "confidence")


def equal_count_bins(rows: DataFrame, p: str, y: str, bins: int, slices: int = 64) -> DataFrame:
    """(bin, mean_confidence, mean_actual) of chunks of max(1, n // bins) rows by (p, y).

    Positions come from a two-level count: equal (p, y) rows are counted first, so the ordered
    window runs over distinct values in ``slices`` ranges of p, not over all rows in one task.
    """
    counts = rows.groupBy(p, y).agg(F.count(F.lit(1)).alias("n")).withColumn("slice", F.floor(F.col(p) * slices))
    totals = counts.groupBy("slice").agg(F.sum("n").alias("slice_n"))
    before_slice = Window.orderBy("slice")  # one row per slice
    bases = totals.select("slice", (F.sum("slice_n").over(before_slice) - F.col("slice_n")).alias("base"), F.sum("slice_n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("slice").orderBy(p, y)
    placed = counts.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(bases), "slice")
    size = F.greatest(F.floor(F.col("total") / bins), F.lit(1))
    first, last = F.col("base") + F.col("upto") - F.col("n"), F.col("base") + F.col("upto") - 1
    spread = placed.select(p, y, first.alias("first"), last.alias("last"), size.alias("size"), F.explode(F.sequence(F.floor(first / size), F.floor(last / size))).alias("bin"))
    share = F.least(F.col("last"), (F.col("bin") + 1) * F.col("size") - 1) - F.greatest(F.col("first"), F.col("bin") * F.col("size")) + 1
    return spread.groupBy("bin").agg(
        F.round(F.sum(F.col(p) * share) / F.sum(share), 9).alias("mean_confidence"), F.round(F.sum(F.col(y) * share) / F.sum(share), 9).alias("mean_actual")
    )


def calibrated(rows: DataFrame, p: str, bins: DataFrame) -> DataFrame:
    """``rows`` with ``calibrated``: linear interpolation between bin means, flat beyond the ends.

    The curve has one row per bin; it is gathered into one array and looked up per row.
    """
    curve = bins.agg(F.array_sort(F.collect_list(F.struct("mean_confidence", "mean_actual"))).alias("_curve"))
    x = F.col(p)
    below = F.filter("_curve", lambda c: c["mean_confidence"] <= x)
    above = F.filter("_curve", lambda c: c["mean_confidence"] > x)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    slope = (b["mean_actual"] - a["mean_actual"]) / (b["mean_confidence"] - a["mean_confidence"])
    value = F.when(a.isNull(), b["mean_actual"]).when(b.isNull(), a["mean_actual"]).otherwise(a["mean_actual"] + slope * (x - a["mean_confidence"]))
    return rows.join(F.broadcast(curve)).withColumn("calibrated", value).drop("_curve")


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (b_only, a_only, statistic, p_value) of the continuity-corrected test on paired hits."""
    counts = rows.agg(
        F.count(F.when(~F.col(a) & F.col(b), 1)).alias("b_only"), F.count(F.when(F.col(a) & ~F.col(b), 1)).alias("a_only")
    )
    b_only, a_only = counts.first()
    n = b_only + a_only
    statistic = (abs(b_only - a_only) - 1) ** 2 / n if n else 0.0
    p = math.erfc(math.sqrt(statistic / 2)) if n else 1.0
    return rows.sparkSession.createDataFrame([(b_only, a_only, statistic, p)], "b_only long, a_only long, statistic double, p_value double")


def distribution(rows: DataFrame, value: str, quantiles: list[float], iqr: float = 1.5) -> DataFrame:
    """One row: count, min, max, mean, median, population deviation, quantiles and outlier fences, to six places."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in [0.25, 0.5, 0.75, *quantiles]]))
    one = rows.agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), q.alias("_q")
    )
    spread = (F.col("_q")[2] - F.col("_q")[0]) * iqr
    six = lambda c: F.round(c, 6)
    return one.select(
        "count",
        *[six(F.col(c)).alias(c) for c in ("min", "max", "mean", "stddev")],
        six(F.col("_q")[1]).alias("median"),
        *[six(F.col("_q")[3 + i]).alias(f"p{int(p * 100)}") for i, p in enumerate(quantiles)],
        six(F.col("_q")[0] - spread).alias("lower_fence"),
        six(F.col("_q")[2] + spread).alias("upper_fence"),
    )
