"""Feature rows from detail blocks, unpivoted ranks and combination statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.functions.rates import safe_div
from rankfield.operators import features as X
from rankfield.operators.store import keep_latest
from rankfield.plans.analogue import ENTRIES_SQL, EVENTS_SQL, entries, events
from rankfield.plans.registry import query
from rankfield.sources.tables import table


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the detail blocks of the fixture schema, counters made from the keys."""

    def block(key, extra=()):
        t, y = key % 40, key % 7
        counters = [("rc", t, y), ("o1", F.floor(t / 5), F.floor(y / 3)), ("o2", F.floor(t / 6), F.floor(y / 4)), ("o3", F.floor(t / 8), F.floor(y / 5))]
        parts = [c.cast("int").alias(f"{name}_{span}") for name, *both in counters for span, c in zip("ty", both, strict=True)]
        return F.when(key % 13 != 0, F.struct(*parts, *extra))

    h, r = F.col("horse_id"), F.col("rider_id")
    rates = [(r % 30 / 100).alias("win_rate_t"), (r % 20 / 100).alias("win_rate_y")]
    return entries(spark, sf_dir).select(
        "race_id",
        "entry_no",
        "race_date",
        F.col("burden").alias("wg_budam"),
        (F.col("rating") * 3).alias("body_weight"),
        F.when(h % 9 != 0, (h % 250).cast("int")).alias("ilsu"),
        (h % 10).cast("int").alias("age"),
        block(h, [(h % 1000).cast("double").alias("prize")]).alias("hr"),
        block(r, rates).alias("jk"),
        block(h + r).alias("tr"),
        block(h + 2 * r).alias("ow"),
        F.when(r % 3 == 0, F.struct((r % 50).cast("double").alias("qnl_rate_t"), (r % 45).cast("double").alias("qnl_rate_y"), (r % 11).cast("int").alias("rc_y"))).alias("jk_stats"),
        F.when(h % 4 != 0, F.struct(F.when(h % 3 == 0, "양호").when(h % 3 == 1, " 불량 ").otherwise("-").alias("state"), F.date_sub("race_date", (h % 8 - 1).cast("int")).alias("trained_on"))).alias("training"),
    )


def _rates(key: str, name: str) -> str:
    t, y = f"({key}) % 40", f"({key}) % 7"
    live = f"({key}) % 13 <> 0"
    return f"""
        CASE WHEN {live} AND {t} <> 0 THEN (floor({t} / 5) + floor({t} / 6) + floor({t} / 8)) / ({t}) END AS {name}_pt,
        CASE WHEN {live} AND {y} <> 0 THEN (floor({y} / 3) + floor({y} / 4) + floor({y} / 5)) / ({y}) END AS {name}_py,
        CASE WHEN {live} AND {t} <> 0 THEN floor({t} / 5) / ({t}) END AS {name}_wt, CASE WHEN {live} AND {y} <> 0 THEN floor({y} / 3) / ({y}) END AS {name}_wy,
        CASE WHEN {live} THEN {y} ELSE 0 END AS {name}_n"""


def _blend(y: str, n: str, t: str, k: int) -> str:
    return f"round(CASE WHEN {t} IS NULL THEN {y} WHEN {y} IS NULL THEN {t} ELSE {n} / ({n} + {k}) * {y} + (1 - {n} / ({n} + {k})) * {t} END, 6)"


@query(
    "WITH "
    + ENTRIES_SQL
    + f""", d AS (SELECT *, {_rates("horse_id", "hr")}, {_rates("rider_id", "jk")}, {_rates("horse_id + rider_id", "tr")}, {_rates("horse_id + 2 * rider_id", "ow")},
            CASE WHEN rider_id % 3 = 0 THEN rider_id % 50 / 100 END AS qt, CASE WHEN rider_id % 3 = 0 THEN rider_id % 45 / 100 END AS qy, rider_id % 11 AS qn FROM entries_v)
        SELECT race_id, entry_no, round(burden / (rating * 3), 6) AS burden_ratio, {_blend("hr_py", "hr_n", "hr_pt", 3)} AS horse_top3_skill,
            CASE WHEN rider_id % 3 = 0 THEN {_blend("qy", "qn", "qt", 15)} ELSE {_blend("jk_py", "jk_n", "jk_pt", 15)} END AS jk_skill, {_blend("tr_py", "tr_n", "tr_pt", 20)} AS tr_skill, {_blend("ow_wy", "ow_n", "ow_wt", 30)} AS owner_skill,
            CASE WHEN horse_id % 9 <> 0 THEN CASE WHEN horse_id % 250 > 180 THEN 'high' WHEN horse_id % 250 > 90 THEN 'medium' ELSE 'low' END END AS rest_risk, horse_id % 10 BETWEEN 4 AND 6 AS age_prime,
            CASE WHEN horse_id % 4 <> 0 THEN CASE horse_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END END AS training_score, CASE WHEN horse_id % 4 <> 0 THEN greatest(0, horse_id % 8 - 1) END AS days_since_training,
            CASE WHEN horse_id % 4 <> 0 THEN horse_id % 8 - 1 <= 3 END AS recent_training FROM d"""
)
def entry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every entry from its detail blocks."""
    rows = X.entry_features(detailed(spark, sf_dir))
    six = ["burden_ratio", "horse_top3_skill", "jk_skill", "tr_skill", "owner_skill"]
    return rows.select(
        "race_id", "entry_no", *[F.round(c, 6).alias(c) for c in six], "rest_risk", "age_prime", "training_score", F.col("days_since_training").cast("long").alias("days_since_training"), "recent_training"
    )


@query(
    "WITH "
    + ENTRIES_SQL
    + """, u AS (SELECT race_id, entry_no, unnest(['rating', 'burden', 'discount']) AS feature, unnest([rating, burden, discount]) AS v, count(*) OVER (PARTITION BY race_id) AS n FROM entries_v),
        d AS (SELECT *, unnest([1, -1]) AS direction FROM u WHERE n >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY race_id, feature, direction ORDER BY v * direction DESC, entry_no) AS rank FROM d)
        SELECT race_id, feature, direction, list_aggregate(list(entry_no ORDER BY rank), 'string_agg', ',') AS best FROM r WHERE rank <= 3 GROUP BY ALL"""
)
def ranked_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three of each event by every feature in both directions, from one unpivot."""
    rows = entries(spark, sf_dir).select("race_id", "entry_no", "rating", "burden", "discount", F.count(F.lit(1)).over(Window.partitionBy("race_id")).alias("n")).filter("n >= 3").drop("n")
    long = rows.unpivot(["race_id", "entry_no"], ["rating", "burden", "discount"], "feature", "v").withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    rank = F.row_number().over(Window.partitionBy("race_id", "feature", "direction").orderBy(F.desc(F.col("v") * F.col("direction")), "entry_no"))
    best = long.withColumn("rank", rank).filter("rank <= 3").groupBy("race_id", "feature", "direction").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_no"))).alias("b"))
    return best.select("race_id", "feature", "direction", F.array_join(F.transform("b", lambda x: x["entry_no"].cast("string")), ",").alias("best"))


@query(
    "WITH "
    + EVENTS_SQL
    + """, c AS (SELECT unnest(['future_finalized', 'missing_date', 'odd_status', 'late_update']) AS code, unnest([race_date > DATE '2000-01-01' AND status = 'O', race_date IS NULL, status NOT IN ('F', 'O'), status = 'P' AND meet = 2]) AS hit FROM events_v)
        SELECT code, count(*) FILTER (hit) AS n FROM c GROUP BY 1"""
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violation codes over event manifests, counted from one unpivot of predicates."""
    rules = {
        "future_finalized": (F.col("race_date") > "2000-01-01") & (F.col("status") == "O"),
        "missing_date": F.col("race_date").isNull(),
        "odd_status": ~F.col("status").isin("F", "O"),
        "late_update": (F.col("status") == "P") & (F.col("meet") == 2),
    }
    codes = F.array(*[F.struct(F.lit(k).alias("code"), v.alias("hit")) for k, v in rules.items()])
    return events(spark, sf_dir).select(F.inline(codes)).groupBy("code").agg(F.count(F.when(F.col("hit"), 1)).alias("n"))


@query(
    """WITH s AS (SELECT s_name AS name, max(s_suppkey) AS k FROM supplier GROUP BY 1), l AS (SELECT p_name, p_partkey, 'Supplier#' || lpad((p_partkey % 150 + 1)::VARCHAR, 9, '0') AS name FROM part)
        SELECT count(*) AS entries, count(s.k) AS matched, count(*) - count(s.k) AS unmatched, coalesce(sum(s.k), 0)::BIGINT AS keys FROM l LEFT JOIN s USING (name)"""
)
def join_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-join on names where the last of equal names wins, with the unmatched counted."""
    known = keep_latest(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")), ["name"], F.desc("k"))
    wanted = table(spark, sf_dir, "part").select(F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 150 + 1).cast("string"), 9, "0")).alias("name"))
    joined = wanted.join(known, "name", "left")
    return joined.agg(F.count(F.lit(1)).alias("entries"), F.count("k").alias("matched"), (F.count(F.lit(1)) - F.count("k")).alias("unmatched"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys"))


@query(
    "WITH "
    + EVENTS_SQL
    + """, r AS (SELECT meet, unnest(generate_series(min(race_date), max(race_date), INTERVAL 1 DAY))::DATE AS d FROM events_v GROUP BY 1), n AS (SELECT meet, race_date AS d, count(*) AS n FROM events_v GROUP BY 1, 2)
        SELECT strftime(d, '%Y%m%d') AS day, meet, coalesce(n, 0) AS collected FROM r LEFT JOIN n USING (meet, d)"""
)
def date_range_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for every day of each meet's range, with the events that are there already; days without any are to be collected."""
    rows = events(spark, sf_dir)
    span = rows.groupBy("meet").agg(F.min("race_date").alias("first"), F.max("race_date").alias("last"))
    days = span.select("meet", F.explode(F.sequence("first", "last")).alias("race_date"))
    there = rows.groupBy("meet", "race_date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(there, ["meet", "race_date"], "left").select(F.date_format("race_date", "yyyyMMdd").alias("day"), "meet", F.coalesce("n", F.lit(0)).alias("collected"))


@query(
    """WITH w AS (SELECT user_id, floor(epoch(ts))::BIGINT // 3600 AS bucket, event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 3600 ORDER BY ts, event_id) AS n FROM events)
        SELECT event_id, greatest(0, 2 - n) AS remaining, n <= 2 AS allowed, (bucket + 1) * 3600 AS reset FROM w"""
)
def tumbling_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of two calls per user and hour: remaining calls, whether allowed, and when the window resets."""
    bucket = F.floor(F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp")) / 3600)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", bucket.alias("bucket"))
    n = F.row_number().over(Window.partitionBy("user_id", "bucket").orderBy("ts", "event_id"))
    return rows.withColumn("n", n).select("event_id", F.greatest(F.lit(0), 2 - F.col("n")).alias("remaining"), (F.col("n") <= 2).alias("allowed"), ((F.col("bucket") + 1) * 3600).alias("reset"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """ SELECT meet, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) FILTER (rating > 75) / count(*), 6) AS strong FROM entries_v GROUP BY meet"""
)
def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares per category."""
    counts = entries(spark, sf_dir).groupBy("meet").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rating") > 75, 1)).alias("s"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("meet", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(safe_div(F.col("s"), F.col("n")), 6).alias("strong"))
