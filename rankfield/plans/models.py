"""Models, resampling, coverage and guarded predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.operators import learning as L
from rankfield.operators import postprocess as G
from rankfield.operators import ranking as R
from rankfield.operators.evaluation import hits
from rankfield.plans.analogue import ENTRIES_SQL, entries
from rankfield.plans.prediction import PREDICTIONS_SQL, outcomes, scored
from rankfield.plans.registry import query
from rankfield.sources.staging import staged

FEATURES = ["rating", "burden", "discount", "win_odds", "skill", "starts", "top3"]


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with target = placed among the first three."""
    rows = scored(spark, sf_dir).withColumn("target", (F.col("place") <= 3).cast("int"))
    return rows.select("race_id", "race_date", "entry_no", "place", "target", *[F.col(f).cast("double").alias(f) for f in FEATURES])


@query()
def model_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on early events, predict later ones, set match by number of hits."""
    rows = staged(training_rows(spark, sf_dir), "training-rows")  # imputer, weights, fit and both rankings read it
    early = rows.filter("race_date < '1998-01-01'")
    fitted = L.model("logreg", FEATURES, weight="w").fit(early.withColumn("w", L.balanced_weight(early)))
    late = L.scored(fitted, rows.filter("race_date >= '1998-01-01'"), ["race_id", "entry_no", "place"])
    picks = R.top_k_lists(late, "race_id", "entry_no", 3, F.desc("score"), F.desc("entry_no"))
    actual = R.top_k_lists(late, "race_id", "entry_no", 3, F.asc("place"), name="actual")
    return picks.join(actual, "race_id").groupBy(hits(F.col("predicted"), F.col("actual")).alias("hit_count")).agg(F.count(F.lit(1)).alias("races"))


@query()
def hit_rate_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean set match."""
    return L.bootstrap_mean(outcomes(spark, sf_dir).select((F.col("hit_count") / 3).alias("v")), "v")


@query()
def paired_difference_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of a paired difference."""
    rows = outcomes(spark, sf_dir).select((F.col("hit_count") / 3).alias("a"), F.col("winner").cast("double").alias("b"))
    return L.paired_bootstrap(rows, "a", "b")


@query()
def brier_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean squared error of the first picks' probabilities, a continuous measure, by Poisson replicates. Runs when planned."""
    rows = outcomes(spark, sf_dir).select("race_id", "p", F.col("winner").cast("int").alias("y"))
    return L.poisson_bootstrap(rows, F.pow(F.col("p") - F.col("y"), F.lit(2)), ["race_id"])


@query(
    "WITH "
    + ENTRIES_SQL
    + """ SELECT unnest(['rating', 'win_odds', 'discount']) AS feature, unnest([count(rating), count(win_odds), count(discount)]) AS present,
        unnest([count(*) - count(rating), count(*) - count(win_odds), count(*) - count(discount)]) AS missing, round(unnest([count(rating), count(win_odds), count(discount)]) / count(*), 6) AS rate FROM entries_v"""
)
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present and missing values per feature."""
    return L.feature_coverage(entries(spark, sf_dir), ["rating", "win_odds", "discount"]).withColumn("rate", F.round("rate", 6))


PAYLOAD_SQL = """,
    cards_v AS (SELECT race_id, list(entry_no ORDER BY entry_no) AS card, count(*) AS n FROM entries_v GROUP BY 1),
    raw_v AS (
        SELECT race_id, card, CASE race_id % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['1', '2', '3'] WHEN 2 THEN ['2', '2', 'x'] WHEN 3 THEN ['99', '1', '0'] ELSE ['3', '-1', '1', '2'] END AS raw FROM cards_v),
    num_v AS (SELECT *, list_filter(list_transform(raw, lambda x: CASE WHEN regexp_full_match(x, '\\d{1,9}') AND x <> '0' THEN x::INT END), lambda x: x IS NOT NULL) AS numbers FROM raw_v)"""


@query(
    "WITH "
    + ENTRIES_SQL
    + PAYLOAD_SQL.replace("\\\\", "\\")
    + """, i AS (SELECT race_id, concat_ws(',', CASE WHEN len(raw) = 0 THEN 'empty_prediction' END, CASE WHEN len(numbers) < len(raw) THEN 'invalid_number' END, CASE WHEN len(list_distinct(numbers)) < len(numbers) THEN 'duplicate_number' END,
            CASE WHEN NOT list_has_all(card, numbers) THEN 'not_in_card' END, CASE WHEN len(list_intersect(numbers, card)) < 3 THEN 'too_few_candidates' END) AS issues, len(card) AS n FROM num_v)
        SELECT issues, count(*) AS races, count(*) FILTER (n >= 3) AS repairable FROM i GROUP BY 1"""
)
def guarded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of raw payloads and how many can be repaired from the card."""
    cards = entries(spark, sf_dir).groupBy("race_id").agg(F.array_sort(F.collect_list("entry_no")).alias("card"))
    key = F.col("race_id") % 5
    payload = (
        F.when(key == 0, "{}").when(key == 1, '{"predicted":[1,2,3]}').when(key == 2, '{"selected_horses":["2",2,"x"]}').when(key == 3, '{"picks":{"primary":[99,1,0]}}').otherwise('{"prediction":[3,-1,1,2]}')
    )
    rows = cards.select("race_id", "card", G.raw_picks(payload).alias("raw"))
    rows = rows.select(F.array_join(G.issues(F.col("raw"), F.col("card")), ",").alias("issues"), G.guarded(F.col("raw"), F.col("card")).alias("picks"))
    return rows.groupBy("issues").agg(F.count(F.lit(1)).alias("races"), F.count(F.when(F.size("picks") == 3, 1)).alias("repairable"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, c AS (SELECT race_id, hit_count, CASE WHEN len(predicted) <> 3 THEN 'invalid' WHEN p < 0.6 THEN 'deferred' ELSE 'scored' END AS status FROM outcome_v)
        SELECT status, count(*) AS n, round(avg(hit_count / 3), 6) AS set_match, round(avg(hit_count), 6) AS correct FROM c GROUP BY 1"""
)
def score_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by score status."""
    rows = outcomes(spark, sf_dir).select("hit_count", G.score_status(F.col("predicted"), F.col("confidence"), 0.6).alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit_count") / 3), 6).alias("set_match"), F.round(F.avg("hit_count"), 6).alias("correct"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """ SELECT race_id, hit_count, 'best' AS kind FROM (SELECT * FROM outcome_v WHERE hit_count = 3 ORDER BY confidence DESC, race_id LIMIT 10)
        UNION ALL SELECT race_id, hit_count, 'failure' FROM (SELECT * FROM outcome_v WHERE hit_count = 0 ORDER BY confidence DESC, race_id LIMIT 5)"""
)
def balanced_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and failed predictions, a few of each: a top-k report."""
    rows = outcomes(spark, sf_dir)
    part = lambda n, k, name: rows.filter(F.col("hit_count") == n).orderBy(F.desc("confidence"), "race_id").limit(k).select("race_id", "hit_count", F.lit(name).alias("kind"))
    return part(3, 10, "best").union(part(0, 5, "failure"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, entry_no) <= 3 AS hit FROM entries_v)
        SELECT 'rating' AS factor, floor(rating / 15)::BIGINT AS bin, count(*) AS n, round(avg(hit::INT), 6) AS rate FROM b GROUP BY ALL
        UNION ALL SELECT 'discount', CASE WHEN discount >= 0.08 THEN 2 WHEN discount >= 0.04 THEN 1 ELSE 0 END, count(*), round(avg(hit::INT), 6) FROM b GROUP BY ALL"""
)
def factor_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate by bins of two factors, from one scan."""
    rows = R.ranked(entries(spark, sf_dir), "race_id", F.desc("price"), F.asc("entry_no")).select((F.col("rank") <= 3).cast("int").alias("hit"), "rating", "discount")
    bins = F.array(
        F.struct(F.lit("rating").alias("factor"), F.floor(F.col("rating") / 15).cast("long").alias("bin")),
        F.struct(F.lit("discount").alias("factor"), F.when(F.col("discount") >= 0.08, 2).when(F.col("discount") >= 0.04, 1).otherwise(0).cast("long").alias("bin")),
    )
    return rows.select("hit", F.inline(bins)).groupBy("factor", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("rate"))
