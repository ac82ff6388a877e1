"""Analysis of evaluated picks, pools of examples, votes, recommendations and run verdicts.

Picks are rows (event, entry) with their places, so counts by event are one grouped aggregate and nothing is nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions import clean
from rankfield.operators.store import filled, stable

# Fixed values.
POINTS, BONUS, PICKS = 33.33, 10.0, 3
PRIORITIES = {"high": 0, "medium": 1, "low": 2}
WEIGHT_RANGE, WEIGHT_STEP = (0.1, 0.7), 0.1
FAVOURITE, OUTSIDER, NO_RANK = 3, 7, 99
ABSTAIN_BELOW = 0.6


def with_odds_rank(entries: DataFrame, odds: str = "win_odds") -> DataFrame:
    """``entries`` with ``odds_rank`` among those with odds above 0; others have NO_RANK."""
    live = F.coalesce(F.col(odds) > 0, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("race_id", live).orderBy(odds, "entry_no"))
    return entries.withColumn("odds_rank", F.when(live, rank).otherwise(NO_RANK))


def reward(correct: Column, has_result: Column) -> Column:
    """Struct (correct_count, base_score, bonus, total_score, hit_rate, status); zeros without a result."""
    n = F.when(has_result, correct).otherwise(0)
    bonus = F.when(n == PICKS, BONUS).otherwise(0.0)
    return F.struct(
        n.alias("correct_count"), (n * POINTS).alias("base_score"), bonus.alias("bonus"), (n * POINTS + bonus).alias("total_score"),
        (n / PICKS * 100).alias("hit_rate"), F.when(has_result, "evaluated").otherwise("no_result").alias("status"),
    )


def bucket(correct: Column) -> Column:
    """successful, failed or partial by the number of hits."""
    return F.when(correct == PICKS, "successful").when(correct == 0, "failed").otherwise("partial")


def pick_profiles(picks: DataFrame) -> DataFrame:
    """Per event, of picks with ``hit`` and ``odds_rank``: hits, the sum of odds ranks, extremes, balance and the strategy's label."""
    ranks = picks.groupBy("race_id").agg(
        F.count(F.when(F.col("hit"), 1)).alias("correct"),
        F.sum("odds_rank").alias("rank_sum"),
        F.min("odds_rank").alias("least"),
        F.max("odds_rank").alias("most"),
    )
    mean = F.col("rank_sum") / PICKS
    return ranks.select(
        "race_id",
        "correct",
        "rank_sum",
        (F.col("most") <= FAVOURITE).alias("all_favourites"),
        (F.col("least") >= OUTSIDER).alias("all_outsiders"),
        ((F.col("least") <= FAVOURITE) & (F.col("most") > 6)).alias("balanced"),
        F.when(mean <= 3, "favourites").when(mean <= 5, "middle").otherwise("outsiders").alias("strategy"),
    )


def confidence_label(confidence: Column) -> Column:
    """very high, high, medium or low by 80, 70 and 60."""
    return F.when(confidence >= 80, "very high").when(confidence >= 70, "high").when(confidence >= 60, "medium").otherwise("low")


def share_of_hits(picks: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: for each rule the share of all picks that hit and satisfy it."""
    counted = picks.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col("hit") & rule, 1)).alias(name) for name, rule in rules.items()])
    return counted.select(*[F.coalesce(F.try_divide(F.col(name).cast("double"), F.col("_n")), F.lit(0.0)).alias(name) for name in rules])


def self_consistency(votes: DataFrame) -> DataFrame:
    """(race_id, predicted, score, confidence, abstains) over repeated predictions, rows (race_id, voter, place from 1, item, confidence).

    Borda points 3, 2, 1; ties by first appearance in order of voter and place. The score is the
    three largest frequencies' mean over the number of voters; a single voter's list is taken as it
    is, with score 1. Confidence is the mean over voters times the score, without its fraction.
    """
    voters = votes.groupBy("race_id", "voter").agg(F.first("confidence").alias("c")).groupBy("race_id").agg(F.count(F.lit(1)).alias("k"), F.avg(F.coalesce("c", F.lit(50))).alias("confidence"))
    items = votes.filter(F.col("place") <= PICKS).groupBy("race_id", "item").agg(F.count(F.lit(1)).alias("n"), F.sum(4 - F.col("place")).alias("points"), F.min(F.struct("voter", "place")).alias("seen"))
    by_points = Window.partitionBy("race_id").orderBy(F.desc("points"), "seen")
    placed = items.select("race_id", "item", "n", F.row_number().over(by_points).alias("r"), F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("n"), "seen")).alias("f"))
    best = placed.groupBy("race_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= PICKS, F.struct("r", "item")))), lambda x: x["item"]).alias("predicted"),
        F.sum(F.when(F.col("f") <= PICKS, F.col("n"))).alias("top"),
        F.count(F.when(F.col("f") <= PICKS, 1)).alias("tops"),
    )
    score = F.when(F.col("k") <= 1, 1.0).otherwise(F.col("top") / (F.col("tops") * F.col("k")))
    return best.join(voters, "race_id").withColumn("score", score).select("race_id", "predicted", "score", F.floor(F.col("confidence") * F.col("score")).cast("int").alias("confidence"), (F.col("score") < ABSTAIN_BELOW).alias("abstains"))


def agreed(modifications: DataFrame, keys: list[str], least: int, *order: Column) -> DataFrame:
    """The modification of least priority for each key that at least ``least`` different models propose; ``order`` breaks ties."""
    models = modifications.groupBy(*keys).agg(F.countDistinct("model").alias("models")).filter(F.col("models") >= least)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", *order))
    return modifications.withColumn("_n", first).filter("_n = 1").drop("_n").join(models, keys)


def without_conflicts(recommendations: DataFrame, *order: Column) -> DataFrame:
    """The recommendation of highest priority for each (type, target)."""
    rank = F.coalesce(clean.coded(F.col("priority"), PRIORITIES), F.lit(3))
    first = F.row_number().over(Window.partitionBy("type", "target").orderBy(rank, *order))
    return recommendations.withColumn("_n", first).filter("_n = 1").drop("_n")


def adjusted_weights(weights: Column, changes: Column) -> Column:
    """Weights (map) after changes (array of struct target, action, value) in order: the target within its range, the rest shared equally."""
    low, high = WEIGHT_RANGE

    def step(now: Column, change: Column) -> Column:
        old, by = now[change["target"]], F.when(change["value"] != 0, change["value"]).otherwise(WEIGHT_STEP)
        new = F.when(change["action"] == "increase", F.least(F.lit(high), old + by)).when(change["action"] == "decrease", F.greatest(F.lit(low), old - by)).otherwise(old)
        rest = (1 - new) / F.greatest(F.size(now) - 1, F.lit(1))
        return F.when(old.isNull(), now).otherwise(F.transform_values(now, lambda name, _: F.when(name == change["target"], new).otherwise(rest)))

    return F.aggregate(changes, weights, step)


def consistency(values: Column) -> Column:
    """Aggregate: 1 / (1 + population deviation); 1 with fewer than two values."""
    return F.when(F.count(values) < 2, 1.0).otherwise(1 / (1 + F.stddev_pop(values)))


def example_scores(history: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, usage, average, consistency) of examples by how prompts with them fared.

    With ``order`` an example's values are added as doubles in that order, as SQL adds the rows of a
    table, so a mean that stands at a threshold falls on the same side of it; an example's rows are then
    sorted in one task, which holds none of them. Without, the average is summed in decimals of nine
    places, and a mean at a threshold does not depend on the order in which partitions are added.
    """
    if order:
        history = history.withColumn("_sum", F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        average = F.max_by("_sum", F.struct(*order)) / F.count(value)
    else:
        average = F.avg(F.col(value).cast("decimal(18,9)")).cast("double")
    return history.groupBy(key).agg(F.count(value).alias("usage"), average.alias("average"), consistency(F.col(value)).alias("consistency"))


def fared_well(threshold: float, least_usage: int = 3) -> Column:
    """Whether an example of ``example_scores`` was used rarely or fared well enough."""
    return (F.col("usage") < least_usage) | (F.col("average") >= threshold)


def without_low_performers(scores: DataFrame, threshold: float, least_usage: int = 3) -> DataFrame:
    """Examples that were used rarely or fared well enough."""
    return scores.filter(fared_well(threshold, least_usage))


def verdict(summary: DataFrame, threshold: float) -> DataFrame:
    """``summary`` (expected, recorded, completed, terminal, lowest) with margin, passed and blockers."""
    lowest = F.col("lowest")
    all_done, all_terminal = F.col("completed") >= F.col("expected"), F.col("terminal") >= F.col("recorded")
    blockers = F.array_compact(
        F.array(
            F.when(~all_done, "expected_runs_incomplete"),
            F.when(~all_terminal, "non_terminal_runs_present"),
            F.when(lowest.isNull(), "lowest_hit_rate_missing").when(lowest < threshold, "below_threshold"),
        )
    )
    return summary.select("*", F.round(lowest - threshold, 6).alias("margin"), blockers.alias("blockers")).withColumn("passed", F.size("blockers") == 0)


def worst_run(runs: DataFrame, *metrics: str) -> DataFrame:
    """The completed run of least first metric (or the next one, where no run has it), then seed, then id."""
    done = runs.filter(F.col("status") == "completed")
    have = done.agg(*[F.count(m).alias(f"_{m}") for m in metrics])
    chosen = F.coalesce(*[F.when(F.col(f"_{m}") > 0, F.struct(F.col(m).isNull().alias("none"), F.col(m).alias("value"))) for m in metrics])
    scored = done.join(F.broadcast(have)).withColumn("_by", chosen).filter("_by IS NOT NULL AND NOT _by.none")  # one row of counts
    return scored.orderBy("_by.value", "seed_index", "run_id").limit(1).drop("_by", *[f"_{m}" for m in metrics])


def heuristic_picks(entries: DataFrame) -> DataFrame:
    """(race_id, predicted, confidence): three entries by place rate and a share of the odds, then total rate, then odds rank.

    Rows have the counters starts_y, places_y, starts_t, places_t (null is 0), win_odds (null is 99)
    and odds_rank (null is 999). The total rate is places_t / (starts_t + 15), the year's rate
    places_y / (starts_y + 2), or the total one for an entry without a start. Confidence is 0.52 +
    0.45 of the picks' mean score, within [0.55, 0.88]. An event with fewer than three entries has
    no picks and confidence 0.
    """
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    total = count("places_t") / (count("starts_t") + 15)
    year = F.when(count("starts_y") > 0, count("places_y") / (count("starts_y") + 2)).otherwise(total)
    scored = entries.select(
        "race_id", "entry_no", (year + 0.06 / F.greatest(F.coalesce("win_odds", F.lit(99.0)), F.lit(1.01))).alias("score"), total.alias("total"), F.coalesce("odds_rank", F.lit(999)).alias("odds_rank")
    )
    order = F.struct((-F.col("score")).alias("a"), (-F.col("total")).alias("b"), "odds_rank", "entry_no", "score")
    best = scored.groupBy("race_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, PICKS).alias("best"))  # an event's entries are tens
    mean = F.aggregate("best", F.lit(0.0), lambda s, x: s + x["score"]) / PICKS
    enough = F.size("best") == PICKS
    picked = F.when(enough, F.transform("best", lambda x: x["entry_no"])).otherwise(F.array().cast("array<int>"))
    return best.select("race_id", picked.alias("predicted"), F.when(enough, F.least(F.greatest(0.52 + 0.45 * mean, F.lit(0.55)), F.lit(0.88))).otherwise(0.0).alias("confidence"))


def changed_state(entries: DataFrame, notices: DataFrame, source_present: Column) -> DataFrame:
    """``entries`` with ``changed``: 1 or 0 by the last notice of the entry, null where the event's source is missing, and the notice's ``to``."""
    last = F.row_number().over(Window.partitionBy("race_date", "race_no", "entry_no").orderBy(F.desc("seq")))
    known = notices.filter(F.col("change_type") == "jockey").withColumn("_n", last).filter("_n = 1").select("race_date", "race_no", "entry_no", F.col("to").alias("changed_to"), F.lit(1).alias("_has"))
    joined = entries.join(known, ["race_date", "race_no", "entry_no"], "left")
    return joined.withColumn("changed", F.when(source_present, F.coalesce("_has", F.lit(0)))).withColumn("changed_to", F.when(source_present, F.col("changed_to"))).drop("_has")


def order_alignment(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: the shares of answered events whose first three entries, as they stand and sorted, equal the answer in order.

    Entries have race_id, pos and entry_no; answers race_id, place (1 to 3) and entry_no.
    """
    first = lambda order, name: F.row_number().over(Window.partitionBy("race_id").orderBy(order)).alias(name)
    placed = entries.select("race_id", "entry_no", first("pos", "raw"), first("entry_no", "sorted"))
    joined = answers.filter(F.col("place") <= PICKS).join(placed, ["race_id", "entry_no"], "left")
    per = joined.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("raw") == F.col("place")).cast("int")).alias("raw"), F.sum((F.col("sorted") == F.col("place")).cast("int")).alias("sorted"))
    share = lambda c: F.avg((F.coalesce(F.col(c), F.lit(0)) == PICKS).cast("double")).alias(c)
    return per.filter(F.col("n") == PICKS).agg(F.count(F.lit(1)).alias("races"), share("raw"), share("sorted"))


def entry_number(c: Column) -> Column:
    """A whole number, or the first digits of a text; fractions and truth values are none."""
    text = F.trim(c.cast("string"))
    value = text.try_cast("double")
    whole = F.when(value == F.floor(value), value.cast("int"))
    return F.when(F.lower(text).isin("true", "false", ""), None).when(value.isNotNull(), whole).otherwise(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"))


def normalised_before_split(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Entries (race_id, chul_no and fields, nested ones too) with a number, one per (event, number): the fullest, then the first as text.

    Leaves are counted at any depth. ``copies`` says how many rows stood for it.
    """
    numbered = rows.withColumn("chul_no", entry_number(F.col("chul_no"))).filter("chul_no IS NOT NULL")
    whole = F.struct(*fields)
    kind = numbered.select(whole.alias("x")).schema["x"].dataType
    order = F.struct((-filled(whole, kind)).alias("n"), F.to_json(stable(whole, kind)).alias("text"))
    best = numbered.groupBy("race_id", "chul_no").agg(F.min_by(whole, order).alias("_row"), F.count(F.lit(1)).alias("copies"))
    return best.select("race_id", "chul_no", "_row.*", "copies")


def past_of_either_key(targets: DataFrame, past: DataFrame) -> DataFrame:
    """(id, race_id) of past events that match a target (id, hr_no, entry_no, race_date) by horse or by entry number, once each.

    The OR is a union of two equi-joins, so neither side is compared as a whole; only earlier events count.
    """
    by = lambda key: targets.alias("t").join(past.alias("p"), (F.col(f"t.{key}") == F.col(f"p.{key}")) & (F.col("p.race_date") < F.col("t.race_date"))).select("t.id", "p.race_id")
    return by("hr_no").union(by("entry_no")).distinct()


def past_counts_of_either_key(targets: DataFrame, past: DataFrame) -> DataFrame:
    """(id, races): how many events ``past_of_either_key`` finds for each target that has any; ids are unique.

    Events by one key, plus those by the other, less those by both: each is a running count over the
    first days of a key's events, with targets set among them, so no pair of a target and an event is made.
    """
    named = past.select(F.col("hr_no").alias("_h"), F.col("entry_no").alias("_e"), "race_id", "race_date").filter("race_date IS NOT NULL")
    wanted = targets.select(F.col("hr_no").alias("_h"), F.col("entry_no").alias("_e"), "id", "race_date")
    first = lambda key: named.filter(F.col(key).isNotNull()).groupBy(key, "race_id").agg(F.min("race_date").alias("race_date"))

    def before(firsts: DataFrame, keys: list[str], sign: int) -> DataFrame:
        asked = wanted.dropna(subset=[*keys, "race_date"]).select(*keys, "race_date", F.lit(0).alias("_n"), "id")
        both = asked.union(firsts.select(*keys, "race_date", F.lit(1), F.lit(None).cast(wanted.schema["id"].dataType)))
        running = Window.partitionBy(*keys).orderBy("race_date", "_n").rowsBetween(Window.unboundedPreceding, 0)  # targets stand before the events of their day
        return both.withColumn("races", sign * F.sum("_n").over(running)).filter("_n = 0 AND races <> 0").select("id", "races")

    horses = first("_h")
    # By both keys only events count whose second key is a target's.
    numbers = first("_e").join(wanted.select("_e").distinct(), "_e", "left_semi")
    common = horses.join(numbers.withColumnRenamed("race_date", "_other"), "race_id").withColumn("race_date", F.greatest("race_date", "_other"))
    counts = before(horses, ["_h"], 1).union(before(numbers, ["_e"], 1)).union(before(common, ["_h", "_e"], -1))
    return counts.groupBy("id").agg(F.sum("races").alias("races"))


def person_rates(detail: Column, names: dict[str, tuple[str, str, str]]) -> list[Column]:
    """Rates of a jockey or trainer: rate / 100 where it is not zero, else count / starts, else 0. ``names``: out -> (rate, count, starts)."""
    found = []
    for out, (rate, count, starts) in names.items():
        given = F.when(detail[rate] != 0, detail[rate] / 100)
        found.append(F.coalesce(given, F.try_divide(detail[count].cast("double"), F.nullif(detail[starts].cast("double"), F.lit(0.0))), F.lit(0.0)).alias(out))
    return found


def newest_window_before(windows: DataFrame, live_from: Column) -> DataFrame:
    """The window of latest train_end before the first live date, then of last name."""
    return windows.filter(F.col("train_end") < live_from).orderBy(F.desc("train_end"), F.desc("name")).limit(1)


def flattened_windows(predictions: DataFrame) -> DataFrame:
    """One prediction per event over windows; the later window overwrites."""
    last = F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("window")))
    return predictions.withColumn("_n", last).filter("_n = 1").drop("_n")
