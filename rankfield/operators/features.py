"""Per-entry features from the detail blocks of horse, rider, trainer, owner and training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.functions.clean import coded
from rankfield.functions.rates import blend, place_rate, safe_div

# Words of training reports, and shrinkage strengths of each block.
TRAINING_SCORES = {"양호": 1, "보통": 0, "불량": -1}
SHRINK = {"hr": 3, "jk": 15, "tr": 20, "ow": 30}
LONG_REST, MEDIUM_REST = 180, 90
PRIME_AGES = (4, 6)
RECENT_TRAINING_DAYS = 3


def percent(rate: Column) -> Column:
    """A rate in percent with two decimals."""
    return F.round(rate * 100, 2)


def rest_risk(days: Column) -> Column:
    """high, medium or low by days of rest."""
    return F.when(days > LONG_REST, "high").when(days > MEDIUM_REST, "medium").when(days.isNotNull(), "low")


def places(block: str, span: str) -> Column:
    """Place rate of a block (hr, jk, tr) over a span (t: all time, y: this year)."""
    c = lambda name: F.col(f"{block}.{name}_{span}")
    return place_rate(c("o1"), c("o2"), c("o3"), c("rc"))


def skill(block: str) -> Column:
    """Place rate of the year shrunken towards that of all time."""
    return blend(places(block, "y"), F.coalesce(F.col(f"{block}.rc_y"), F.lit(0)), places(block, "t"), SHRINK[block])


def rider_skill() -> Column:
    """From the rider's quinella rates where there are any, else from the rider's detail block."""
    stats = blend(F.col("jk_stats.qnl_rate_y") / 100, F.coalesce(F.col("jk_stats.rc_y"), F.lit(0)), F.col("jk_stats.qnl_rate_t") / 100, SHRINK["jk"])
    return F.when(F.col("jk_stats").isNotNull(), stats).otherwise(skill("jk"))


def entry_features(entries: DataFrame) -> DataFrame:
    """``entries`` with one column per feature; what cannot be computed is null. One projection, no shuffle.

    Expects wg_budam, body_weight, ilsu, age, race_date, the blocks hr, jk, tr, ow (counters rc, o1, o2, o3 by
    _t and _y), jk_stats and training.
    """
    win = lambda block, span: safe_div(F.col(f"{block}.o1_{span}"), F.col(f"{block}.rc_{span}"))
    days = F.datediff("race_date", F.col("training.trained_on"))
    starts_y = F.col("hr.rc_y")
    return entries.select(
        "*",
        safe_div(F.col("wg_budam"), F.col("body_weight")).alias("burden_ratio"),
        percent(win("jk", "t")).alias("jockey_win_rate"),
        percent(places("jk", "t")).alias("jockey_place_rate"),
        safe_div(F.col("jk.win_rate_y"), F.col("jk.win_rate_t")).alias("jockey_form"),
        percent(win("jk", "y")).alias("jockey_recent_win_rate"),
        percent(win("hr", "t")).alias("horse_win_rate"),
        percent(places("hr", "t")).alias("horse_place_rate"),
        safe_div(F.col("hr.prize"), F.col("hr.rc_t")).alias("horse_avg_prize"),
        percent(win("tr", "t")).alias("trainer_win_rate"),
        percent(places("tr", "t")).alias("trainer_place_rate"),
        F.col("ilsu").alias("rest_days"),
        rest_risk(F.col("ilsu")).alias("rest_risk"),
        F.col("age").between(*PRIME_AGES).alias("age_prime"),
        skill("hr").alias("horse_top3_skill"),
        starts_y.alias("horse_starts_y"),
        F.coalesce(starts_y < 3, F.lit(True)).alias("horse_low_sample"),
        F.col("jk_stats.qnl_rate_y").alias("jk_qnl_rate_y"),
        F.col("jk_stats.qnl_rate_t").alias("jk_qnl_rate_t"),
        rider_skill().alias("jk_skill"),
        skill("tr").alias("tr_skill"),
        coded(F.trim(F.col("training.state")), TRAINING_SCORES).alias("training_score"),
        F.col("training").isNull().alias("training_missing"),
        F.greatest(F.when(days.isNotNull(), F.lit(0)), days).alias("days_since_training"),
        (days <= RECENT_TRAINING_DAYS).alias("recent_training"),
        percent(win("ow", "t")).alias("owner_win_rate"),
        blend(win("ow", "y"), F.coalesce(F.col("ow.rc_y"), F.lit(0)), win("ow", "t"), SHRINK["ow"]).alias("owner_skill"),
    )


def distance_flags(distance: Column) -> list[Column]:
    """is_sprint, is_mile, is_route by distance."""
    return [(distance <= 1200).alias("is_sprint"), ((distance > 1200) & (distance <= 1600)).alias("is_mile"), (distance > 1600).alias("is_route")]
