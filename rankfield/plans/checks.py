"""Validation of entries and events, id sets, diverse examples and pipeline summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.operators import validation as V
from rankfield.operators.store import keep_latest
from rankfield.plans.analogue import ENTRIES_SQL, EVENTS_SQL, entries, events
from rankfield.plans.prediction import PREDICTIONS_SQL, outcomes
from rankfield.plans.registry import query
from rankfield.sources.tables import table


@query(
    """WITH r AS (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dup, l_quantity - 2 <= 0 AS young, l_quantity > 45 AS heavy, l_discount = 0 AS bare FROM lineitem),
        x AS (SELECT unnest(CASE WHEN NOT dup AND NOT young AND NOT heavy THEN CASE WHEN bare THEN ['core_missing'] ELSE [] END
            ELSE list_filter([CASE WHEN dup THEN 'chul_no_duplicate' END, CASE WHEN young THEN 'age_invalid' END, CASE WHEN heavy THEN 'wg_budam_outlier' END], lambda v: v IS NOT NULL) END) AS reason FROM r)
        SELECT reason, count(*) AS n FROM x GROUP BY 1"""
)
def exclusion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why entries are excluded; line numbers repeat within orders, which makes duplicates."""
    rows = table(spark, sf_dir, "lineitem")
    reasons = V.exclusion_reasons("l_linenumber", "l_orderkey", F.col("l_quantity") - 2, F.col("l_quantity") > 45, F.col("l_discount") == 0)
    return V.reason_audit(rows.select(reasons.alias("reasons")))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, e AS (SELECT race_id, count(*) AS n, avg((discount > 0)::INT) AS q, count(*) FILTER (win_odds IS NULL) AS bad FROM entries_v GROUP BY 1)
        SELECT CASE WHEN n < 3 THEN 'too_few_entries' WHEN q < 0.8 THEN 'low_quality' WHEN bad > 0 THEN 'invalid_odds' ELSE 'passed' END AS verdict, count(*) AS events, sum(n)::BIGINT AS entries FROM e GROUP BY 1"""
)
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the first check that they fail."""
    per = entries(spark, sf_dir).groupBy("race_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("discount") > 0).cast("int")).alias("q"), F.count(F.when(F.col("win_odds").isNull(), 1)).alias("bad"))
    verdict = V.event_verdict(F.col("n"), F.col("q"), F.col("bad"), 3, 0.8)
    return per.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("events"), F.sum("n").alias("entries"))


@query(
    "WITH "
    + EVENTS_SQL
    + """, a AS (SELECT race_id FROM events_v WHERE race_id % 3 <> 0), b AS (SELECT race_id FROM events_v WHERE race_id % 5 <> 0)
        SELECT side, count(*) AS n, min(race_id) AS first_id FROM (SELECT race_id, 'missing' AS side FROM a WHERE race_id NOT IN (SELECT race_id FROM b) UNION ALL SELECT race_id, 'unexpected' FROM b WHERE race_id NOT IN (SELECT race_id FROM a)) GROUP BY 1"""
)
def id_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one set only, both ways."""
    ids = events(spark, sf_dir).select("race_id")
    found = V.id_mismatches(ids.filter("race_id % 3 <> 0"), ids.filter("race_id % 5 <> 0"), "race_id")
    return found.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("race_id").alias("first_id"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, s AS (SELECT race_id, confidence, list_aggregate(list_sort(predicted), 'string_agg', '-') AS signature FROM outcome_v WHERE hit_count >= 2),
        f AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY confidence DESC, race_id) AS n FROM s)
        SELECT signature, race_id FROM f WHERE n = 1"""
)
def diverse_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best example of every signature of picks."""
    signature = F.array_join(F.array_sort("predicted").cast("array<string>"), "-")
    rows = outcomes(spark, sf_dir).filter("hit_count >= 2").select("race_id", "confidence", signature.alias("signature"))
    return keep_latest(rows, ["signature"], F.desc("confidence"), F.asc("race_id")).select("signature", "race_id")


@query(
    """SELECT event_type AS stage, count(*) AS total, count(*) FILTER (value > 10) AS succeeded, round(count(*) FILTER (value > 10) / count(*), 6) AS success_rate, round(avg(value), 4) AS mean_time, round(sum(value), 2) AS total_time FROM events GROUP BY 1"""
)
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes and times per pipeline stage; missing times are ignored."""
    good = F.count(F.when(F.col("value") > 10, 1))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count(F.lit(1)).alias("total"), good.alias("succeeded"), F.round(good / F.count(F.lit(1)), 6).alias("success_rate"), F.round(F.avg("value"), 4).alias("mean_time"), F.round(F.sum("value"), 2).alias("total_time")
    )


@query(
    """WITH e AS (SELECT user_id, ts, event_id, sum(CASE WHEN epoch(ts) - epoch(p) <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)),
        g AS (SELECT user_id, s, count(*) AS n, min(ts) AS a, max(ts) AS b FROM e GROUP BY ALL)
        SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM g GROUP BY 1"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, cut by gaps of more than an hour."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", at.alias("at"))
    rows = rows.withColumn("gap", F.col("at") - F.lag("at").over(order)).withColumn("s", F.sum(F.when(F.col("gap") <= 3_600_000_000, 0).otherwise(1)).over(order))
    per = rows.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))
