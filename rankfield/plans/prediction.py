"""From entries to top-3 predictions and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.functions.rates import blend, dense_share, ordinal_rank, ordinal_share, over_group, place_rate, safe_div
from rankfield.operators import evaluation as E
from rankfield.operators import ranking as R
from rankfield.operators.history import rolling_history
from rankfield.plans.analogue import ENTRIES_SQL, entries
from rankfield.plans.registry import query


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their finishing place."""
    return R.ranked(entries(spark, sf_dir), "race_id", F.desc("price"), F.asc("entry_no"), name="place")


FINISHED_SQL = (
    ENTRIES_SQL
    + """,
    finished_v AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, entry_no) AS place FROM entries_v)"""
)


def with_history(rows: DataFrame) -> DataFrame:
    """90-day and 730-day history of each horse-like key: starts, wins, top3; only entries with positive odds count."""
    live = (F.coalesce("win_odds", F.lit(0)) > 0).cast("long")
    measures = {"starts": live, "wins": live * (F.col("place") == 1).cast("long"), "top3": live * (F.col("place") <= 3).cast("long")}
    return rolling_history(rows, "horse_id", "race_date", {"": 90, "_t": 730}, measures)


HISTORY_SQL = (
    FINISHED_SQL
    + """,
    live_v AS (SELECT *, (coalesce(win_odds, 0) > 0)::INT AS live FROM finished_v),
    daily_v AS (
        SELECT horse_id, race_date, sum(live) AS s, sum(live * (place = 1)::INT) AS w, sum(live * (place <= 3)::INT) AS t
        FROM live_v GROUP BY ALL),
    past_v AS (
        SELECT horse_id, race_date,
            coalesce(sum(s) OVER a, 0)::BIGINT AS starts, coalesce(sum(w) OVER a, 0)::BIGINT AS wins, coalesce(sum(t) OVER a, 0)::BIGINT AS top3,
            coalesce(sum(s) OVER b, 0)::BIGINT AS starts_t, coalesce(sum(w) OVER b, 0)::BIGINT AS wins_t, coalesce(sum(t) OVER b, 0)::BIGINT AS top3_t
        FROM daily_v WINDOW
            a AS (PARTITION BY horse_id ORDER BY race_date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
            b AS (PARTITION BY horse_id ORDER BY race_date RANGE BETWEEN INTERVAL 730 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    history_v AS (SELECT * FROM live_v JOIN past_v USING (horse_id, race_date)),
    skill_v AS (
        SELECT *, CASE WHEN starts_t > 0 THEN top3_t / starts_t END AS rate_t, CASE WHEN starts > 0 THEN top3 / starts END AS rate_y FROM history_v),
    scored_v AS (
        SELECT *, CASE WHEN rate_t IS NULL THEN rate_y WHEN rate_y IS NULL THEN rate_t
            ELSE starts / (starts + 3) * rate_y + (1 - starts / (starts + 3)) * rate_t END AS skill FROM skill_v)"""
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with history and their shrunken skill."""
    rows = with_history(finished(spark, sf_dir))
    skill = blend(safe_div(F.col("top3"), F.col("starts")), F.col("starts"), safe_div(F.col("top3_t"), F.col("starts_t")), 3)
    return rows.withColumn("skill", skill)


RANK_KEYS = [("skill", True), ("rating", True), ("burden", False)]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: predicted and actual first three, first pick's odds, confidence."""
    rows = scored(spark, sf_dir)
    ordered = R.ranked(rows, "race_id", *R.composite_order(RANK_KEYS, ["entry_no"]))
    picks = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "entry_no"))))
    actual = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "entry_no"))))
    return ordered.groupBy("race_id", "race_date", "meet").agg(
        F.transform(picks, lambda x: x["entry_no"]).alias("predicted"),
        F.transform(actual, lambda x: x["entry_no"]).alias("actual"),
        F.max(F.when(F.col("rank") == 1, F.col("win_odds"))).alias("odds"),
        F.max(F.when(F.col("rank") == 1, 40 + 500 * F.col("discount"))).alias("confidence"),
        F.count(F.lit(1)).alias("field_size"),
    )


PREDICTIONS_SQL = (
    HISTORY_SQL
    + """,
    ranked_v AS (
        SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY skill DESC NULLS LAST, rating DESC NULLS LAST, burden NULLS LAST, entry_no) AS rank FROM scored_v),
    predictions_v AS (
        SELECT race_id, race_date, meet,
            list(entry_no ORDER BY rank) FILTER (rank <= 3) AS predicted, list(entry_no ORDER BY place) FILTER (place <= 3) AS actual,
            max(win_odds) FILTER (rank = 1) AS odds, max(40 + 500 * discount) FILTER (rank = 1) AS confidence, count(*) AS field_size
        FROM ranked_v GROUP BY ALL),
    outcome_v AS (
        SELECT *, len(list_intersect(predicted, actual)) AS hit_count, predicted[1] = actual[1] AS winner,
            least(greatest(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END, 1e-6), 1 - 1e-6) AS p FROM predictions_v)"""
)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with hits, whether the first pick won, and the clipped confidence."""
    return predictions(spark, sf_dir).select(
        "*",
        E.hits(F.col("predicted"), F.col("actual")).alias("hit_count"),
        (F.col("predicted")[0] == F.col("actual")[0]).alias("winner"),
        E.probability(F.col("confidence")).alias("p"),
    )


@query("WITH " + HISTORY_SQL + " SELECT race_id, entry_no, horse_id, starts, wins, top3, starts_t, wins_t, top3_t, round(skill, 6) AS skill FROM scored_v")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time look-back and shrunken skill of every entry."""
    columns = ["race_id", "entry_no", "horse_id", "starts", "wins", "top3", "starts_t", "wins_t", "top3_t"]
    return scored(spark, sf_dir).select(*columns, F.round("skill", 6).alias("skill"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """ SELECT meet, count(*) AS races, count(*) FILTER (hit_count = 3) AS exact, count(*) FILTER (hit_count = 2) AS two,
        count(*) FILTER (hit_count = 1) AS one, count(*) FILTER (hit_count = 0) AS none,
        round(avg(hit_count / 3), 6) AS set_match, round(avg((hit_count = 3)::INT), 6) AS exact_rate FROM outcome_v GROUP BY meet"""
)
def flagship_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, shrinkage, ranks, top-3 and their set match, by meet."""
    n = F.col("hit_count")
    counts = [F.count(F.when(n == k, 1)).alias(name) for k, name in ((3, "exact"), (2, "two"), (1, "one"), (0, "none"))]
    return outcomes(spark, sf_dir).groupBy("meet").agg(
        F.count(F.lit(1)).alias("races"), *counts, F.round(F.avg(n / 3), 6).alias("set_match"), F.round(F.avg((n == 3).cast("int")), 6).alias("exact_rate")
    )


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """ SELECT round(avg(-(winner::INT * ln(p) + (1 - winner::INT) * ln(1 - p))), 6) AS log_loss, round(avg((p - winner::INT) ** 2), 6) AS brier,
        round(avg((list_contains(predicted, actual[1]))::INT), 6) AS top_3, round(avg(winner::INT), 6) AS top_1,
        count(*) FILTER (odds > 0) AS bets, count(*) FILTER (odds > 0 AND winner) AS wins,
        round(sum(CASE WHEN odds > 0 THEN CASE WHEN winner THEN odds - 1 ELSE -1 END END), 4) AS total_profit,
        round(avg((p - hit_count / 3) ** 2), 6) AS brier_set, round(avg((p >= 0.6)::INT), 6) AS coverage, count(*) FILTER (p < 0.6) AS deferred, count(*) AS samples
        FROM outcome_v"""
)
def prediction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss, Brier scores, top-k, return on stake and coverage in one pass."""
    y, p = F.col("winner").cast("int"), F.col("p")
    bet = F.col("odds") > 0
    profit = F.when(bet, F.when(F.col("winner"), F.col("odds") - 1).otherwise(-1.0))
    return outcomes(spark, sf_dir).agg(
        F.round(E.log_loss(y, p), 6).alias("log_loss"),
        F.round(E.brier(y, p), 6).alias("brier"),
        F.round(F.avg(F.array_contains("predicted", F.col("actual")[0]).cast("int")), 6).alias("top_3"),
        F.round(F.avg(y), 6).alias("top_1"),
        F.count(F.when(bet, 1)).alias("bets"),
        F.count(F.when(bet & F.col("winner"), 1)).alias("wins"),
        F.round(F.sum(profit), 4).alias("total_profit"),
        F.round(F.avg(F.pow(p - F.col("hit_count") / 3, F.lit(2))), 6).alias("brier_set"),
        F.round(F.avg((p >= 0.6).cast("int")), 6).alias("coverage"),
        F.count(F.when(p < 0.6, 1)).alias("deferred"),
        F.count(F.lit(1)).alias("samples"),
    )


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, bins AS (SELECT least(floor(p * 10)::INT, 9) AS bin, count(*) AS n, avg(winner::INT) AS a, avg(p) AS c FROM outcome_v GROUP BY 1)
        SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM bins"""
)
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error of the first picks."""
    rows = outcomes(spark, sf_dir).select(F.col("winner").cast("int").alias("y"), "p")
    return E.expected_calibration_error(rows, "y", "p").select(F.round("ece", 6).alias("ece"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, bins AS (SELECT least(floor(p * 10)::INT, 9) AS bin, count(*) AS n, avg(winner::INT) AS a, avg(p) AS c FROM outcome_v GROUP BY 1)
        SELECT i::INT AS bin, coalesce(n, 0) AS n, round(a, 6) AS accuracy, round(c, 6) AS confidence FROM generate_series(0, 9) g(i) LEFT JOIN bins ON bin = i"""
)
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability diagram with empty bins."""
    rows = outcomes(spark, sf_dir).select(F.col("winner").cast("int").alias("y"), "p")
    found = E.reliability_diagram(rows, "y", "p")
    return found.select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


CALIBRATION_SQL = """,
    sorted_v AS (
        SELECT p, winner::INT AS y, row_number() OVER (ORDER BY p, winner) - 1 AS i, greatest(count(*) OVER () // 10, 1) AS size FROM outcome_v),
    curve_v AS (SELECT i // size AS bin, round(avg(p), 9) AS x, round(avg(y), 9) AS z FROM sorted_v GROUP BY 1)"""


@query("WITH " + PREDICTIONS_SQL + CALIBRATION_SQL + " SELECT bin, round(x, 6) AS mean_confidence, round(z, 6) AS mean_actual FROM curve_v")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-count calibration chunks."""
    rows = outcomes(spark, sf_dir).select(F.col("winner").cast("int").alias("y"), "p")
    found = E.equal_count_bins(rows, "p", "y", 10)
    return found.select("bin", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("mean_actual", 6).alias("mean_actual"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + CALIBRATION_SQL
    + """, lines AS (SELECT x, z, lead(x) OVER (ORDER BY x, z) AS x2, lead(z) OVER (ORDER BY x, z) AS z2 FROM curve_v)
        SELECT race_id, round(CASE WHEN p < (SELECT min(x) FROM curve_v) THEN (SELECT arg_min(z, (x, z)) FROM curve_v)
            ELSE (SELECT coalesce(z + (z2 - z) / (x2 - x) * (p - x), z) FROM lines l WHERE l.x <= o.p ORDER BY x DESC, z DESC LIMIT 1) END, 6) AS calibrated
        FROM outcome_v o"""
)
def calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences mapped through the calibration curve."""
    rows = outcomes(spark, sf_dir).select("race_id", F.col("winner").cast("int").alias("y"), "p")
    found = E.calibrated(rows, "p", E.equal_count_bins(rows, "p", "y", 10))
    return found.select("race_id", F.round("calibrated", 6).alias("calibrated"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, bands AS (SELECT *, CASE WHEN field_size <= 2 THEN 'small' WHEN field_size <= 5 THEN 'medium' ELSE 'large' END AS field_band,
            CASE WHEN date_part('month', race_date) <= 6 THEN 'first' ELSE 'second' END AS half,
            (SELECT sum(x) FROM (SELECT unnest(list_transform(predicted, lambda q, i: CASE WHEN list_contains(actual, q) THEN 4 - list_position(actual, q) ELSE 0 END / log2(i + 1))) AS x)) AS dcg,
            (SELECT sum((4 - i) / log2(i + 1)) FROM generate_series(1, len(actual)) g(i)) AS idcg FROM outcome_v)
        SELECT field_band, half, meet, count(*) AS n, round(avg((hit_count = 3)::INT), 6) AS full_match, round(avg(hit_count / 3), 6) AS set_match, round(avg(dcg / idcg), 6) AS ndcg3
        FROM bands GROUP BY GROUPING SETS ((field_band), (half), (meet))"""
)
def stratified_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full match, set match and NDCG by field size, season and meet, in one pass of grouping sets."""
    band = F.when(F.col("field_size") <= 2, "small").when(F.col("field_size") <= 5, "medium").otherwise("large")
    half = F.when(F.month("race_date") <= 6, "first").otherwise("second")
    rows = outcomes(spark, sf_dir).select(band.alias("field_band"), half.alias("half"), "meet", "hit_count", E.ndcg(F.col("predicted"), F.col("actual")).alias("ndcg"))
    grouped = rows.groupingSets([["field_band"], ["half"], ["meet"]], "field_band", "half", "meet")
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("hit_count") == 3).cast("int")), 6).alias("full_match"),
        F.round(F.avg(F.col("hit_count") / 3), 6).alias("set_match"),
        F.round(F.avg("ndcg"), 6).alias("ndcg3"),
    )


@query(
    "WITH "
    + HISTORY_SQL
    + """, ranks AS (
        SELECT race_id, entry_no,
            row_number() OVER (PARTITION BY race_id ORDER BY coalesce(win_odds, 9999), pos) AS odds_rank,
            row_number() OVER (PARTITION BY race_id ORDER BY coalesce(rating, 0) DESC, pos) AS rating_rank,
            row_number() OVER (PARTITION BY race_id ORDER BY skill DESC NULLS LAST, pos) AS skill_rank,
            row_number() OVER (PARTITION BY race_id ORDER BY coalesce(burden, 999), pos) AS burden_rank,
            row_number() OVER (PARTITION BY race_id ORDER BY coalesce(skill, 0) DESC, pos) AS gap_rank,
            coalesce(skill, 0) AS s, count(*) OVER (PARTITION BY race_id) AS field_size FROM scored_v)
        SELECT race_id, entry_no, odds_rank, rating_rank, skill_rank, burden_rank, field_size,
            round(max(CASE WHEN gap_rank = 3 THEN s END) OVER (PARTITION BY race_id) - max(CASE WHEN gap_rank = 4 THEN s END) OVER (PARTITION BY race_id), 6) AS gap FROM ranks"""
)
def race_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal ranks in the event, field size and the gap between the third and fourth skill."""
    rows = scored(spark, sf_dir).withColumn("_pos", F.col("pos"))
    filled = F.coalesce("skill", F.lit(0.0))
    whole = over_group("race_id")
    ranks = rows.select(
        "race_id",
        "entry_no",
        ordinal_rank("race_id", F.coalesce("win_odds", F.lit(9999)).asc(), F.asc("pos")).alias("odds_rank"),
        ordinal_rank("race_id", F.coalesce("rating", F.lit(0)).desc(), F.asc("pos")).alias("rating_rank"),
        ordinal_rank("race_id", F.col("skill").desc_nulls_last(), F.asc("pos")).alias("skill_rank"),
        ordinal_rank("race_id", F.coalesce("burden", F.lit(999)).asc(), F.asc("pos")).alias("burden_rank"),
        F.count(F.lit(1)).over(whole).alias("field_size"),
        F.sort_array(F.collect_list(filled).over(whole), asc=False).alias("_skills"),
    )
    gap = F.try_element_at("_skills", F.lit(3)) - F.try_element_at("_skills", F.lit(4))
    return ranks.select("race_id", "entry_no", "odds_rank", "rating_rank", "skill_rank", "burden_rank", "field_size", F.round(gap, 6).alias("gap"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, dense AS (
        SELECT *, dense_rank() OVER (PARTITION BY race_id ORDER BY coalesce(win_odds, -999999) DESC) AS r1, dense_rank() OVER (PARTITION BY race_id ORDER BY coalesce(burden, 999999)) AS r2,
            row_number() OVER (PARTITION BY race_id ORDER BY rating DESC, pos DESC) AS r3, count(*) OVER (PARTITION BY race_id) AS n FROM entries_v),
        tops AS (SELECT *, max(r1) OVER (PARTITION BY race_id) AS t1, max(r2) OVER (PARTITION BY race_id) AS t2 FROM dense)
        SELECT race_id, entry_no, round(CASE WHEN t1 = 1 THEN 0.5 ELSE (r1 - 1) / (t1 - 1) END, 6) AS odds_rr, round(CASE WHEN t2 = 1 THEN 0.5 ELSE (r2 - 1) / (t2 - 1) END, 6) AS burden_rr,
            round(CASE WHEN n = 1 THEN 1.0 ELSE (r3 - 1) / (n - 1) END, 6) AS rating_ordinal FROM tops"""
)
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and ordinal percentile ranks in the event."""
    rows = entries(spark, sf_dir)
    rows = rows.select("race_id", "entry_no", F.struct("win_odds", "burden", F.struct("rating", "pos").alias("place")).alias("own"))
    rows = rows.select("*", F.collect_list("own").over(over_group("race_id")).alias("all"))
    return rows.select(
        "race_id",
        "entry_no",
        F.round(dense_share(F.col("all.win_odds"), F.col("own.win_odds"), reverse=True), 6).alias("odds_rr"),
        F.round(dense_share(F.col("all.burden"), F.col("own.burden")), 6).alias("burden_rr"),
        F.round(ordinal_share(F.col("all.place"), F.col("own.place")), 6).alias("rating_ordinal"),
    )


VOTERS_SQL = """,
    lists_v AS (
        SELECT race_id, v, list(entry_no ORDER BY r) FILTER (r <= 3) AS items FROM (
            SELECT race_id, entry_no, 1 AS v, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, entry_no) AS r FROM entries_v
            UNION ALL SELECT race_id, entry_no, 2, row_number() OVER (PARTITION BY race_id ORDER BY rating DESC, entry_no) FROM entries_v
            UNION ALL SELECT race_id, entry_no, 3, row_number() OVER (PARTITION BY race_id ORDER BY discount DESC, entry_no) FROM entries_v)
        GROUP BY ALL)"""


def voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(race_id, v, items): top-3 lists of three predictors."""
    return voted(spark, sf_dir).select("race_id", F.inline("lists")).select("race_id", "v", "items")


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(race_id, lists): an event's top-3 lists of three predictors as structs (v, items), from its entries gathered once."""
    keys = ["price", "rating", "discount"]
    rows = R.gathered(entries(spark, sf_dir), "race_id", "entry_no", ["entry_no", *keys])
    lists = [F.struct(F.lit(i + 1).alias("v"), R.first_items(F.col("all"), "entry_no", 3, (k, True)).alias("items")) for i, k in enumerate(keys)]
    return rows.select("race_id", F.array(*lists).alias("lists"))


@query(
    "WITH "
    + ENTRIES_SQL
    + VOTERS_SQL
    + """, votes AS (SELECT race_id, v, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS place FROM lists_v),
        points AS (SELECT race_id, item, sum((CASE v WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END)::DOUBLE * (3 - place)) AS score, min(v * 10 + place) AS seen FROM votes GROUP BY ALL),
        counts AS (SELECT race_id, item, count(*) AS c FROM votes GROUP BY ALL),
        freq AS (SELECT race_id, sum(c) FILTER (k <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY c DESC) AS k FROM counts) GROUP BY ALL),
        best AS (SELECT race_id, list(item ORDER BY round(score, 9) DESC, seen) AS items FROM points GROUP BY ALL)
        SELECT race_id, list_aggregate(items[1:3], 'string_agg', ',') AS winners, round(top / 9.0, 6) AS consistency, top / 9.0 < 0.6 AS abstain FROM best JOIN freq USING (race_id)"""
)
def weighted_borda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted rank voting of three predictors, its consistency and whether to abstain."""
    weight = lambda v: F.when(v == 1, 0.5).when(v == 2, 0.3).otherwise(0.2)
    best = R.borda_of_groups(voted(spark, sf_dir), "race_id", "lists", "v", "items", weight)
    count = lambda x: F.size(F.filter("voted", lambda n: n == x["item"])).cast("long")
    best = best.select("race_id", "ks", F.sort_array(F.transform("ks", count), asc=False).alias("cs"))
    share = F.aggregate(F.slice("cs", 1, 3), F.lit(0).cast("long"), lambda a, x: a + x) / 9.0
    winners = F.concat_ws(",", F.transform(F.slice("ks", 1, 3), lambda x: x["item"].cast("string")))
    return best.select("race_id", winners.alias("winners"), F.round(share, 6).alias("consistency"), (share < 0.6).alias("abstain"))


@query(
    "WITH "
    + ENTRIES_SQL
    + VOTERS_SQL
    + """, pairs AS (SELECT a.race_id, len(list_intersect(a.items, b.items)) AS o, len(list_distinct(list_concat(a.items, b.items))) AS u FROM lists_v a JOIN lists_v b ON a.race_id = b.race_id AND a.v < b.v),
        means AS (SELECT race_id, avg(o) AS overlap, avg(o / u) AS jaccard FROM pairs GROUP BY ALL)
        SELECT race_id, round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard, CASE WHEN overlap = 3 THEN 'unanimous' WHEN overlap >= 2 THEN 'majority' ELSE 'split' END AS agreement FROM means"""
)
def voter_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise overlap and Jaccard similarity of the predictors."""
    found = R.pair_overlaps(voters(spark, sf_dir), "race_id", "v", "items")
    label = F.when(F.col("overlap") == 3, "unanimous").when(F.col("overlap") >= 2, "majority").otherwise("split")
    return found.select("race_id", F.round("overlap", 6).alias("overlap"), F.round("jaccard", 6).alias("jaccard"), label.alias("agreement"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, pairs AS (SELECT hit_count >= 2 AS a, winner AS b FROM outcome_v), n AS (SELECT count(*) FILTER (NOT a AND b) AS b_only, count(*) FILTER (a AND NOT b) AS a_only FROM pairs)
        SELECT b_only, a_only, round(CASE WHEN a_only + b_only > 0 THEN (abs(b_only - a_only) - 1) ** 2 / (a_only + b_only) ELSE 0 END, 6) AS statistic FROM n"""
)
def paired_hits_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """McNemar's test of two hit definitions."""
    rows = outcomes(spark, sf_dir).select((F.col("hit_count") >= 2).alias("a"), F.col("winner").alias("b"))
    return E.mcnemar(rows, "a", "b").select("b_only", "a_only", F.round("statistic", 6).alias("statistic"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """ SELECT count(*) AS n, round(avg(p * (odds - 1) - (1 - p)), 6) AS expected_value FROM outcome_v WHERE odds IS NOT NULL"""
)
def expected_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean expected value of a unit stake on first picks."""
    rows = outcomes(spark, sf_dir).filter("odds is not null")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("p") * (F.col("odds") - 1) - (1 - F.col("p"))), 6).alias("expected_value"))


@query(
    "WITH "
    + FINISHED_SQL
    + """, d AS (SELECT race_date, count(*) FILTER (place <= 3)::DOUBLE / count(*) AS v FROM finished_v GROUP BY 1)
        SELECT count(v) AS count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev, round(quantile_cont(v, 0.5), 6) AS median,
            round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90,
            round(quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 6) AS lower_fence,
            round(quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 6) AS upper_fence FROM d"""
)
def metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution and outlier fences of a daily rate."""
    daily = finished(spark, sf_dir).groupBy("race_date").agg((F.count(F.when(F.col("place") <= 3, 1)) / F.count(F.lit(1))).alias("v"))
    return E.distribution(daily, "v", [0.1, 0.9])


@query("WITH " + ENTRIES_SQL + " SELECT race_id, round(sum(rating) / sum(burden), 6) AS form, count(*) AS n, round((max(rating) + min(rating) + avg(rating)) / sum(burden), 6) AS place_rate FROM entries_v GROUP BY 1")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe ratios per event."""
    rows = entries(spark, sf_dir).groupBy("race_id").agg(F.sum("rating").alias("r"), F.sum("burden").alias("b"), F.max("rating").alias("hi"), F.min("rating").alias("lo"), F.avg("rating").alias("mid"), F.count(F.lit(1)).alias("n"))
    return rows.select("race_id", F.round(safe_div(F.col("r"), F.col("b")), 6).alias("form"), "n", F.round(place_rate(F.col("hi"), F.col("lo"), F.col("mid"), F.col("b")), 6).alias("place_rate"))
