"""Turning raw prediction payloads into three valid, distinct picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PICKS = 3
#: Payload fields in order of precedence.
FIELDS = ["selected_horses", "predicted", "prediction", "picks.primary"]


def raw_picks(payload: Column) -> Column:
    """The first of the payload's fields that is a non-empty list, as texts."""
    lists = [F.from_json(F.get_json_object(payload, f"$.{field}"), "array<string>") for field in FIELDS]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))


def entry_number(text: Column) -> Column:
    """A strictly positive integer without sign, else null."""
    return F.when(text.rlike(r"^\d{1,9}$") & (text.try_cast("int") > 0), text.try_cast("int"))


def issues(raw: Column, valid: Column) -> Column:
    """What is wrong with the raw picks."""
    numbers = F.array_compact(F.transform(raw, entry_number))
    return F.array_compact(
        F.array(
            F.when(F.size(raw) == 0, "empty_prediction"),
            F.when(F.size(numbers) < F.size(raw), "invalid_number"),
            F.when(F.size(F.array_distinct(numbers)) < F.size(numbers), "duplicate_number"),
            F.when(F.size(F.array_except(numbers, valid)) > 0, "not_in_card"),
            F.when(F.size(F.array_intersect(numbers, valid)) < PICKS, "too_few_candidates"),
        )
    )


def guarded(raw: Column, card: Column) -> Column:
    """Valid distinct picks in order, filled from the card in card order up to three."""
    numbers = F.array_distinct(F.array_compact(F.transform(raw, entry_number)))
    return F.slice(F.array_distinct(F.concat(F.array_intersect(numbers, card), card)), 1, PICKS)


def score_status(picks: Column, confidence: Column, threshold: float) -> Column:
    """invalid without three picks, deferred under the confidence threshold (percent above 1), else scored."""
    value = F.when(confidence > 1, confidence / 100).otherwise(confidence)
    return F.when(F.size(picks) != PICKS, "invalid").when(value < threshold, "deferred").otherwise("scored")


def merged_candidates(candidates: DataFrame, group: str) -> DataFrame:
    """One row per (group, number) of (group, number, score, name, index): best score first, then index; missing names and scores filled in."""
    order = Window.partitionBy(group, "number").orderBy(F.col("score").desc_nulls_last(), "index")
    first = candidates.withColumn("_n", F.row_number().over(order))
    whole = Window.partitionBy(group, "number").orderBy(F.col("score").desc_nulls_last(), "index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = first.withColumn("name", F.coalesce("name", F.first("name", ignorenulls=True).over(whole)))
    return filled.filter("_n = 1").drop("_n")
