"""Choosing between combinations of three that share two entries with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ITEMS = 3


def combination_key(items):
    """Sorted triple; null unless there are three distinct items."""
    triple = F.array_sort(F.array_distinct(F.slice(items, 1, ITEMS)))
    return F.when(F.size(triple) == ITEMS, triple)


def select_overlapping(candidates: DataFrame, fallbacks: DataFrame, sources: int, add: float, drop: float, pair: float, bias: float) -> DataFrame:
    """(race_id, chosen, switched, score) from candidates (race_id, combo, score, support) and fallbacks (race_id, fallback).

    Items and pairs of an event weigh the sum of score + support / sources over the candidates
    that hold them. A candidate that shares two items with the fallback scores its own score plus
    added, less dropped, plus kept pair, each weighted; the best one replaces the fallback if it
    reaches the fallback's score plus ``bias``. An event's candidates, one for each different
    combination of its sources, are gathered once and meet its fallback in one join.
    """
    held = candidates.groupBy("race_id").agg(F.collect_list(F.struct("combo", "score", "support")).alias("candidates"))
    return chosen_overlapping(fallbacks.join(held, "race_id", "left"), sources, add, drop, pair, bias)


def chosen_overlapping(events: DataFrame, sources: int, add: float, drop: float, pair: float, bias: float) -> DataFrame:
    """As ``select_overlapping``, of events (race_id, fallback, candidates), where candidates are structs (combo, score, support): a map, without shuffles."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    weight = lambda x: zero(x["score"] + x["support"] / F.lit(max(sources, 1)))
    held = lambda has: F.aggregate(F.filter("candidates", has), F.lit(0.0), lambda s, x: s + weight(x))
    rows = events.select("race_id", "fallback", F.coalesce("candidates", F.array()).alias("candidates"))
    # Weights are needed of items only, and of the three pairs that a fallback can keep, named by the item it drops.
    items = F.array_distinct(F.concat(F.flatten(F.transform("candidates", lambda x: x["combo"])), "fallback"))
    rows = rows.withColumn("_items", items)
    by_item = F.map_from_arrays("_items", F.transform("_items", lambda i: held(lambda x: F.array_contains(x["combo"], i))))
    by_pair = F.map_from_arrays("fallback", F.transform("fallback", lambda i: held(lambda x: F.size(F.array_intersect(x["combo"], F.array_remove("fallback", i))) == 2)))
    rows = rows.select("race_id", "fallback", "candidates", by_item.alias("_item"), by_pair.alias("_pair"))

    def total(x: Column) -> Column:
        added, dropped = F.array_except(x["combo"], "fallback")[0], F.array_except("fallback", x["combo"])[0]
        value = x["score"] + add * zero(F.col("_item")[added]) - drop * zero(F.col("_item")[dropped]) + pair * zero(F.col("_pair")[dropped])
        value = F.round(value, 9)
        return F.struct(value.isNull().alias("none"), (-value).alias("down"), (-x["support"]).alias("rare"), x["combo"].alias("combo"), value.alias("total"))

    near = F.filter("candidates", lambda x: F.size(F.array_intersect(x["combo"], "fallback")) == 2)
    own = F.array_max(F.transform(F.filter("candidates", lambda x: x["combo"] == F.col("fallback")), lambda x: x["score"]))
    rows = rows.select("race_id", "fallback", F.array_min(F.transform(near, total)).alias("_best"), own.alias("own")).select("race_id", "fallback", F.col("_best.combo").alias("best"), F.col("_best.total").alias("total"), "own")
    switch = F.coalesce(F.col("total") >= zero(F.col("own")) + bias, F.lit(False))
    return rows.select(
        "race_id", F.when(switch, F.col("best")).otherwise(F.col("fallback")).alias("chosen"), switch.alias("switched"), F.when(switch, F.col("total")).otherwise(zero(F.col("own"))).alias("score")
    )
