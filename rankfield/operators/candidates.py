"""Which entries of an event may be predicted: status rules, re-inclusion and the last fallback.

All steps are columns over one window per event; nothing loops over events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions.clean import number

#: Fewest candidates of an event, and the order in which excluded ones come back.
LEAST_CANDIDATES = 3
REINCLUSION = {"zero_market_signal": 10, "wg_budam_outlier": 20}


def cancellation_status(reason: Column) -> Column:
    """withdrawn, excluded or cancelled by the words of an official reason."""
    return F.when(reason.contains("기권"), "withdrawn").when(reason.contains("제외"), "excluded").otherwise("cancelled")


def with_cancellations(rows: DataFrame, cancelled: DataFrame, group: str, keys: list[str], status: str) -> DataFrame:
    """``rows`` with ``status`` of the first cancellation that matches by the keys in turn; first row wins per key value."""
    found = []
    for n, key in enumerate(keys):
        first = cancelled.filter(F.col(key).isNotNull()).groupBy(group, key).agg(F.min_by(status, "pos").alias(f"_c{n}"))
        rows = rows.join(first, [group, key], "left")
        found.append(F.col(f"_c{n}"))
    return rows.withColumn(status, F.coalesce(*found)).drop(*[f"_c{n}" for n in range(len(keys))])


def exclusion_reason(entry_no: Column, official: Column, burden: Column, win_odds: Column, place_odds: Column) -> Column:
    """Why an entry is excluded, by precedence; null for normal ones."""
    weight = number(burden)
    given = F.coalesce(~burden.cast("string").isin("", "-"), F.lit(False))
    zero = lambda c: F.coalesce(number(c) == 0, F.lit(False))
    return (
        F.when(entry_no.isNull(), "invalid_entry_missing_chul_no")
        .when(official.isNotNull(), official)
        .when(given & F.coalesce((weight < 40) | (weight > 65), F.lit(True)), "wg_budam_outlier")
        .when(zero(win_odds) | zero(place_odds), "zero_market_signal")
    )


def select_candidates(rows: DataFrame, group: str, pos: str, reason: str, minimum_info: Column) -> DataFrame:
    """``rows`` with ``stage``: eligible, reincluded, fallback or null (left out).

    Short events take back excluded entries by (priority, position) up to the shortage, then
    entries with minimum information that were not officially cancelled, by position.
    """
    event = Window.partitionBy(group)
    ok = F.col(reason).isNull()
    priority = F.coalesce(*[F.when(F.col(reason) == name, F.lit(p)) for name, p in REINCLUSION.items()])
    counted = rows.withColumn("_short", F.lit(LEAST_CANDIDATES) - F.count(F.when(ok, 1)).over(event)).withColumn("_priority", priority)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_priority").asc_nulls_last(), pos))
    counted = counted.withColumn("_back", F.coalesce(F.col("_priority").isNotNull() & (place <= F.col("_short")), F.lit(False)))
    counted = counted.withColumn("_still", F.col("_short") - F.count(F.when(F.col("_back"), 1)).over(event))
    official = F.coalesce(F.col(reason).isin("cancelled", "withdrawn", "excluded"), F.lit(False))
    spare = counted.withColumn("_spare", ~ok & ~F.col("_back") & ~official & F.coalesce(minimum_info, F.lit(False)))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_spare"), pos))
    stage = F.when(ok, "eligible").when(F.col("_back"), "reincluded").when(F.col("_spare") & (turn <= F.col("_still")), "fallback")
    return spare.withColumn("stage", stage).drop("_short", "_priority", "_back", "_still", "_spare")


def shortage_class(eligible: Column, total: Column, reasons: Column) -> Column:
    """Why an event is short, from the set of reason classes present."""
    return (
        F.when(eligible >= LEAST_CANDIDATES, "sufficient_candidates")
        .when(total < LEAST_CANDIDATES, "raw_field_too_small")
        .when(F.size(reasons) == 0, "unknown_reasons_reduced_below_minimum")
        .when(F.size(reasons) > 1, "mixed_reasons_reduced_below_minimum")
        .otherwise(F.concat(reasons[0], F.lit("_reduced_below_minimum")))
    )


def reason_class(reason: Column) -> Column:
    """official_status, market_signal, data_quality or unknown_reasons."""
    return (
        F.when(reason.isin("cancelled", "withdrawn", "excluded"), "official_status")
        .when(reason == "zero_market_signal", "market_signal")
        .when(reason.isin("wg_budam_outlier", "invalid_entry_missing_chul_no"), "data_quality")
        .when(reason.isNotNull(), "unknown_reasons")
    )


def weight_flags(c: Column) -> Column:
    """Flags of a body weight text such as 480(+5)."""
    value = F.trim(c.cast("string"))
    blank = F.coalesce(value.isin("", "-", "0()", "0"), F.lit(True))
    shape = r"^(\d+)(?:\(([+-]?\d+)\))?$"
    bad = ~blank & ~value.rlike(shape)
    weight, delta = F.regexp_extract(value, shape, 1).try_cast("double"), F.regexp_extract(value, shape, 2)
    good = ~blank & ~bad
    return F.array_compact(
        F.array(
            F.when(blank, "weight_missing"),
            F.when(bad, "weight_parse_failed"),
            F.when(good & ~weight.between(200, 650), "weight_outlier"),
            F.when(blank | (good & (delta == "")), "weight_delta_missing"),
            F.when(bad, "weight_delta_parse_failed"),
            F.when(good & (delta != "") & ~delta.try_cast("double").between(-40, 40), "weight_delta_outlier"),
        )
    )
