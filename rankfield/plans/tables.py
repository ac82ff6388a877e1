"""Joins, status counts, deduplication, upserts, splits and combination mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.operators import history as H
from rankfield.operators import splits as P
from rankfield.operators import store as S
from rankfield.plans.analogue import ENTRIES_SQL, EVENTS_SQL, entries, events
from rankfield.plans.prediction import PREDICTIONS_SQL, predictions
from rankfield.plans.registry import query
from rankfield.sources.tables import table


@query("WITH " + EVENTS_SQL + " SELECT race_id, race_date, meet FROM events_v WHERE status = 'F' AND race_date >= DATE '1995-01-01' ORDER BY race_date, meet, race_id LIMIT 100", dates=("race_date",))
def scan_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of collected events in key order."""
    found = events(spark, sf_dir).filter((F.col("status") == "F") & (F.col("race_date") >= "1995-01-01"))
    return found.select("race_id", "race_date", "meet").orderBy("race_date", "meet", "race_id").limit(100)


@query("WITH " + EVENTS_SQL + " SELECT race_id, race_date, CASE meet WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'third' END AS meet_name FROM events_v ORDER BY race_date DESC, race_id LIMIT 20 OFFSET 40", dates=("race_date",))
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the newest events."""
    name = F.when(F.col("meet") == 1, "first").when(F.col("meet") == 2, "second").otherwise("third")
    return events(spark, sf_dir).orderBy(F.desc("race_date"), "race_id").offset(40).limit(20).select("race_id", "race_date", name.alias("meet_name"))


@query(
    """WITH v AS (SELECT c_custkey AS k, o_orderkey AS id, o_orderdate::DATE AS d, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey),
        t AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE + 30 AS cutoff FROM orders WHERE o_orderstatus = 'F')
        SELECT t.k, t.cutoff, v.id, v.price FROM t LEFT JOIN LATERAL (SELECT id, price FROM v WHERE v.k = t.k AND v.d <= t.cutoff ORDER BY d DESC, id LIMIT 1) v ON true""",
    dates=("cutoff",),
)
def latest_before_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward as-of join: the newest version of a key at a cutoff."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    targets = orders.filter("o_orderstatus = 'F'").select("k", F.date_add("d", 30).alias("cutoff")).distinct()
    return H.latest_before(targets, orders.drop("o_orderstatus"), "k", "cutoff", "d", [F.asc("id")]).select("k", "cutoff", "id", "price")


def _lookback(rows: DataFrame) -> DataFrame:
    targets = rows.select("horse_id", "race_date")
    past = rows.select("horse_id", "race_date", "price", F.col("race_date").alias("past_date"))
    measures = {"races": F.count(F.lit(1)), "mean_price": F.round(F.avg("price"), 4), "last_date": F.max("past_date")}
    return H.lookback(targets, past, "horse_id", "race_date", 90, measures)


@query(
    "WITH "
    + ENTRIES_SQL
    + """, t AS (SELECT DISTINCT horse_id, race_date FROM entries_v)
        SELECT t.horse_id, t.race_date, count(*) AS races, round(avg(h.price), 4) AS mean_price, max(h.race_date) AS last_date
        FROM t JOIN entries_v h ON h.horse_id = t.horse_id AND h.race_date < t.race_date AND h.race_date >= t.race_date - 90 GROUP BY ALL""",
    dates=("race_date", "last_date"),
)
def range_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucketed range join: history of [date - 90, date) for every key and date."""
    return _lookback(entries(spark, sf_dir))


@query("WITH " + EVENTS_SQL + " SELECT race_id, race_date FROM events_v WHERE status = 'F' AND race_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')", dates=("race_date",))
def events_without_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join: events that lack any row of a fact table."""
    odds = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("race_id"))
    return events(spark, sf_dir).filter("status = 'F'").join(odds, "race_id", "left_anti").select("race_id", "race_date")


@query(
    """WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate::DATE AS created, o_orderdate::DATE + 60 AS as_of, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT l_orderkey, count(*) AS rows, count(*) FILTER (created <= as_of) AS kept, count(*) FILTER (created > as_of) AS blocked, round(sum(CASE WHEN created <= as_of THEN l_discount END), 4) AS discount
        FROM c GROUP BY 1"""
)
def timing_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined blocks that were created after the as-of time are dropped and counted."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    created, as_of = F.to_date("l_shipdate"), F.date_add(F.to_date("o_orderdate"), 60)
    return lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(created <= as_of, 1)).alias("kept"),
        F.count(F.when(created > as_of, 1)).alias("blocked"),
        F.round(F.sum(H.guarded(F.col("l_discount"), created, as_of)), 4).alias("discount"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(s_name, 'unknown') AS supplier, coalesce(round(s_acctbal / 100, 4), 0.0) AS rate, s_name IS NULL AS missing
        FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey"""
)
def enrich_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join of a dimension with default values for what is missing."""
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    joined = table(spark, sf_dir, "lineitem").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        F.coalesce("s_name", F.lit("unknown")).alias("supplier"),
        F.coalesce(F.round(F.col("s_acctbal") / 100, 4), F.lit(0.0)).alias("rate"),
        F.col("s_name").isNull().alias("missing"),
    )


@query(
    "WITH "
    + EVENTS_SQL
    + """ SELECT meet, count(*) AS total, count(*) FILTER (status = 'F') AS finished, count(*) FILTER (status = 'O') AS open, count(*) FILTER (status = 'P') AS partial, max(race_date) AS last_date,
        CASE WHEN count(*) FILTER (status = 'F') = count(*) THEN 'complete' WHEN count(*) FILTER (status = 'F') > 0 THEN 'partial' ELSE 'pending' END AS state FROM events_v GROUP BY meet""",
    dates=("last_date",),
)
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered counts by status and the derived state."""
    counts = {name: F.count(F.when(F.col("status") == code, 1)) for code, name in (("F", "finished"), ("O", "open"), ("P", "partial"))}
    state = F.when(counts["finished"] == F.count(F.lit(1)), "complete").when(counts["finished"] > 0, "partial").otherwise("pending")
    return events(spark, sf_dir).groupBy("meet").agg(F.count(F.lit(1)).alias("total"), *[c.alias(n) for n, c in counts.items()], F.max("race_date").alias("last_date"), state.alias("state"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, s AS (SELECT race_id, ((win_odds IS NOT NULL AND win_odds <> 0)::INT + (rating <> 0)::INT + (discount <> 0)::INT) / 3 AS basic, ((discount <> 0)::INT + (flag <> '')::INT) / 2 AS extra FROM entries_v)
        SELECT race_id, round(avg(basic), 6) AS basic, round(avg(0.6 * basic + 0.4 * extra), 6) AS overall FROM s GROUP BY 1"""
)
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of truthy fields per event, weighted."""
    basic = (S.truthy(F.col("win_odds")) + S.truthy(F.col("rating")) + S.truthy(F.col("discount"))) / 3
    extra = (S.truthy(F.col("discount")) + S.truthy(F.col("flag"))) / 2
    return entries(spark, sf_dir).groupBy("race_id").agg(F.round(F.avg(basic), 6).alias("basic"), F.round(F.avg(0.6 * basic + 0.4 * extra), 6).alias("overall"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY race_date DESC, race_id, entry_no) AS rn FROM entries_v)
        SELECT horse_id, count(*) AS races, count(*) FILTER (entry_no = 1) AS wins, round(count(*) FILTER (entry_no = 1) / count(*), 6) AS win_rate, round(avg(entry_no), 6) AS mean_place,
            round(sum(greatest(0, 11 - entry_no) * (6 - rn)) FILTER (rn <= 5) / (sum(6 - rn) FILTER (rn <= 5) * 10), 6) AS recent_form FROM n GROUP BY 1"""
)
def performance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, mean place and the weighted form of the newest five."""
    newest = Window.partitionBy("horse_id").orderBy(F.desc("race_date"), "race_id", "entry_no")
    rows = entries(spark, sf_dir).withColumn("rn", F.row_number().over(newest))
    recent = lambda c: F.sum(F.when(F.col("rn") <= 5, c))
    won = F.count(F.when(F.col("entry_no") == 1, 1))
    form = recent(F.greatest(F.lit(0), 11 - F.col("entry_no")) * (6 - F.col("rn"))) / (recent(6 - F.col("rn")) * 10)
    return rows.groupBy("horse_id").agg(
        F.count(F.lit(1)).alias("races"), won.alias("wins"), F.round(won / F.count(F.lit(1)), 6).alias("win_rate"), F.round(F.avg("entry_no"), 6).alias("mean_place"), F.round(form, 6).alias("recent_form")
    )


@query(
    "WITH "
    + ENTRIES_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY win_odds, pos) AS odds_rank, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, pos) AS place FROM entries_v WHERE win_odds > 0),
        b AS (SELECT odds_rank, count(*) AS n, count(*) FILTER (place <= 3) AS top3 FROM r WHERE odds_rank <= 15 GROUP BY 1)
        SELECT odds_rank, n, top3, round(top3 / n, 6) AS rate, round((sum(top3) OVER (ORDER BY odds_rank)) / (sum(n) OVER (ORDER BY odds_rank)), 6) AS cumulative FROM b"""
)
def odds_rank_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and cumulative hit rate by odds rank."""
    event = Window.partitionBy("race_id")
    rows = entries(spark, sf_dir).filter("win_odds > 0").select(
        F.row_number().over(event.orderBy("win_odds", "pos")).alias("odds_rank"), F.row_number().over(event.orderBy(F.desc("price"), "pos")).alias("place")
    )
    bins = rows.filter("odds_rank <= 15").groupBy("odds_rank").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("place") <= 3, 1)).alias("top3"))
    upto = Window.orderBy("odds_rank")  # fifteen rows
    return bins.select("odds_rank", "n", "top3", F.round(F.col("top3") / F.col("n"), 6).alias("rate"), F.round(F.sum("top3").over(upto) / F.sum("n").over(upto), 6).alias("cumulative"))


@query(
    """WITH d AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT user_id, event_type, event_id, value FROM d WHERE n = 1"""
)
def keep_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row per key."""
    return S.keep_latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query(
    """WITH cur AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
        inc AS (SELECT o_orderkey AS k, 'N' AS s, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 2 = 0),
        ok AS (SELECT * FROM inc WHERE k NOT IN (SELECT k FROM cur WHERE s = 'F'))
        SELECT * FROM ok UNION ALL SELECT * FROM cur WHERE k NOT IN (SELECT k FROM ok)"""
)
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert that never replaces finished rows."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    incoming = orders.filter("k % 2 = 0").select("k", F.lit("N").alias("s"), (F.col("v") * 2).alias("v"))
    return S.upsert_unless(orders.filter("k % 3 <> 0"), incoming, ["k"], F.col("s") == "F")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderdate::DATE >= (SELECT date_trunc('month', max(o_orderdate))::DATE - INTERVAL 11 MONTH FROM orders) GROUP BY 1", dates=("month",))
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last twelve months by month."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    last = orders.agg(F.max("d").alias("last"))
    return S.retained(orders.join(F.broadcast(last)), "d", S.month_cutoff(F.col("last"), 12)).groupBy(F.trunc("d", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_name, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY (c_acctbal > 0)::INT DESC, c_custkey) AS n FROM customer)
        SELECT c_nationkey, c_mktsegment, c_custkey FROM c WHERE n = 1"""
)
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest row per key, ties by canonical text."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, "x").alias("filled"), F.format_string("%012d", "c_custkey").alias("a_key"), "c_custkey")
    return S.canonical_rows(rows, ["c_nationkey", "c_mktsegment"]).select("c_nationkey", "c_mktsegment", "c_custkey")


SPLIT_SQL = """,
    placed_v AS (SELECT *, row_number() OVER (ORDER BY race_date, race_id) - 1 AS position, count(*) OVER () AS total FROM events_v)"""


@query("WITH " + EVENTS_SQL + SPLIT_SQL + " SELECT race_id, CASE WHEN position < floor(total * 0.4) THEN 'train' WHEN position < floor(total * 0.4) + floor(total * 0.4) THEN 'dev' ELSE 'test' END AS split FROM placed_v")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40/40/20 in time."""
    return P.fraction_split(events(spark, sf_dir), "race_date", ["race_id"]).select("race_id", "split")


@query(
    "WITH "
    + EVENTS_SQL
    + SPLIT_SQL
    + """, f AS (SELECT *, greatest(1, total // 6) * fold AS first, greatest(1, total // 6) AS size FROM placed_v, generate_series(1, 5) g(fold)),
        s AS (SELECT fold, CASE WHEN position < first - greatest(1, first // 4) THEN 'train' WHEN position < first THEN 'dev' WHEN position < CASE WHEN fold = 5 THEN total ELSE first + size END THEN 'test' END AS split, race_date FROM f)
        SELECT fold::INT AS fold, split, count(*) AS n, min(race_date) AS first_date, max(race_date) AS last_date FROM s WHERE split IS NOT NULL GROUP BY ALL""",
    dates=("first_date", "last_date"),
)
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds and their date ranges."""
    folds = P.walk_forward(events(spark, sf_dir), "race_date", ["race_id"], 5)
    return folds.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.min("race_date").alias("first_date"), F.max("race_date").alias("last_date"))


@query(
    "WITH "
    + EVENTS_SQL
    + """, w(name, train_end, eval_start, eval_end) AS (VALUES ('a', DATE '1994-12-31', DATE '1995-01-01', DATE '1995-12-31'), ('b', DATE '1995-06-30', DATE '1995-07-01', DATE '1996-06-30'))
        SELECT name, CASE WHEN race_date <= train_end THEN 'train' ELSE 'eval' END AS split, count(*) AS n FROM events_v JOIN w ON race_date <= train_end OR race_date BETWEEN eval_start AND eval_end GROUP BY ALL"""
)
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of events in named train and evaluation windows."""
    rows = [("a", "1994-12-31", "1995-01-01", "1995-12-31"), ("b", "1995-06-30", "1995-07-01", "1996-06-30")]
    windows = spark.createDataFrame(rows, "name string, train_end string, eval_start string, eval_end string")
    windows = windows.select("name", *[F.to_date(c).alias(c) for c in ("train_end", "eval_start", "eval_end")])
    return P.window_membership(events(spark, sf_dir), "race_date", windows).groupBy("name", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + EVENTS_SQL
    + """, d AS (SELECT race_date, count(*) AS n, bool_and(status <> 'P') AS whole FROM events_v GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY race_date DESC) - n AS newer FROM d WHERE whole)
        SELECT race_date, n, newer::BIGINT AS newer FROM c WHERE newer < 500""",
    dates=("race_date",),
)
def complete_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest complete dates until 500 events are held."""
    rows = events(spark, sf_dir).withColumn("included", F.col("status") != "P")
    return P.newest_complete_dates(rows, "race_date", "included", 500)


@query(
    "WITH "
    + EVENTS_SQL
    + """, d AS (SELECT race_date, count(*) AS n, bool_and(status <> 'P') AS whole FROM events_v GROUP BY 1), c AS (SELECT race_date, n, sum(n) OVER (ORDER BY race_date DESC) AS upto FROM d WHERE whole),
        a AS (SELECT min(upto) AS t FROM c WHERE upto >= 300), b AS (SELECT min(upto) AS t FROM c, a WHERE upto >= a.t + 120),
        s AS (SELECT c.race_date, CASE WHEN upto <= a.t THEN 'holdout' WHEN upto <= b.t THEN 'mini_val' END AS dataset FROM c, a, b)
        SELECT dataset, count(*) AS races, count(DISTINCT race_date) AS dates, min(race_date) AS first_day, max(race_date) AS last_day, sum(('0x' || substr(md5(race_id::VARCHAR), 1, 12))::BIGINT)::VARCHAR AS digest
        FROM events_v JOIN s USING (race_date) WHERE dataset IS NOT NULL GROUP BY 1""",
    dates=("first_day", "last_day"),
)
def holdout_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest complete dates as a holdout set, those before them for quick validation, with digests of their ids."""
    rows = events(spark, sf_dir).withColumn("included", F.col("status") != "P")
    return P.plan_manifest(P.holdout_plan(rows, "race_date", "included", [("holdout", 300), ("mini_val", 120)]), "race_id", "race_date")


@query(
    "WITH "
    + ENTRIES_SQL
    + """, d AS (SELECT rider_id, race_date, count(*) AS n, count(*) FILTER (entry_no = 1) AS h FROM entries_v GROUP BY ALL)
        SELECT rider_id, race_date, coalesce(sum(n) OVER w, 0)::BIGINT AS prior_n, coalesce(sum(h) OVER w, 0)::BIGINT AS prior_hits FROM d
        WINDOW w AS (PARTITION BY rider_id ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
    dates=("race_date",),
)
def prior_date_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running statistics that only days before the current one have updated."""
    daily = entries(spark, sf_dir).groupBy("rider_id", "race_date").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("entry_no") == 1, 1)).alias("h"))
    before = Window.partitionBy("rider_id").orderBy(H.day_number("race_date")).rangeBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return daily.select("rider_id", "race_date", total("n").alias("prior_n"), total("h").alias("prior_hits"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY win_odds NULLS LAST, pos) AS odds_rank, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, pos) AS place FROM entries_v),
        t AS (SELECT race_id, list_aggregate(list(odds_rank ORDER BY odds_rank), 'string_agg', '-') AS pattern, count(*) AS k FROM r WHERE place <= 3 GROUP BY 1)
        SELECT pattern, count(*) AS n FROM t WHERE k = 3 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, pattern LIMIT 5"""
)
def rank_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent odds-rank triples of the first three."""
    event = Window.partitionBy("race_id")
    rows = entries(spark, sf_dir).select(
        "race_id", F.row_number().over(event.orderBy(F.col("win_odds").asc_nulls_last(), "pos")).alias("odds_rank"), F.row_number().over(event.orderBy(F.desc("price"), "pos")).alias("place")
    )
    triples = rows.filter("place <= 3").groupBy("race_id").agg(F.array_sort(F.collect_list("odds_rank")).alias("t")).filter(F.size("t") == 3)
    counts = triples.groupBy(F.array_join(F.col("t").cast("array<string>"), "-").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n >= 2").orderBy(F.desc("n"), "pattern").limit(5)


@query(
    "WITH "
    + ENTRIES_SQL
    + """, w AS (SELECT race_id, entry_no, rating + 100 * discount AS weight FROM entries_v),
        p AS (SELECT a.race_id, a.entry_no AS x, b.entry_no AS y, a.weight + b.weight AS w FROM w a JOIN w b ON a.race_id = b.race_id AND a.entry_no < b.entry_no),
        r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(w, 6) DESC, x, y) AS n FROM p)
        SELECT race_id, x, y, round(w, 6) AS w FROM r WHERE n = 1"""
)
def best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of entries of each event, ties to the smaller pair."""
    w = entries(spark, sf_dir).select("race_id", "entry_no", (F.col("rating") + 100 * F.col("discount")).alias("weight"))
    a, b = w.alias("a"), w.alias("b")
    pairs = a.join(b, (F.col("a.race_id") == F.col("b.race_id")) & (F.col("a.entry_no") < F.col("b.entry_no")))
    pairs = pairs.select(F.col("a.race_id").alias("race_id"), F.col("a.entry_no").alias("x"), F.col("b.entry_no").alias("y"), F.round(F.col("a.weight") + F.col("b.weight"), 6).alias("w"))
    return S.keep_latest(pairs, ["race_id"], F.desc("w"), F.asc("x"), F.asc("y"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, g AS (SELECT race_id FROM outcome_v WHERE len(predicted) = 3)
        SELECT count(*) AS expected, count(g.race_id) AS covered, count(*) - count(g.race_id) AS missing, min(e.race_id) FILTER (g.race_id IS NULL) AS first_missing FROM events_v e LEFT JOIN g USING (race_id)"""
)
def prediction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events without a complete prediction."""
    expected = events(spark, sf_dir).select("race_id")
    given = predictions(spark, sf_dir).filter(F.size("predicted") == 3).select("race_id", F.lit(1).alias("given"))
    return expected.join(given, "race_id", "left").agg(
        F.count(F.lit(1)).alias("expected"), F.count("given").alias("covered"), (F.count(F.lit(1)) - F.count("given")).alias("missing"), F.min(F.when(F.col("given").isNull(), F.col("race_id"))).alias("first_missing")
    )


@query("SELECT event_type AS kind, props->>'$.k' AS k, count(*) AS n FROM events WHERE (props->>'$.k')::INT < 5 GROUP BY ALL")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of open JSON documents."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").filter(k.try_cast("int") < 5).groupBy(F.col("event_type").alias("kind"), k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", dates=("minute",))
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and minute."""
    window = F.window("ts", "1 minute")
    found = table(spark, sf_dir, "events").groupBy("event_type", window).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("event_type", F.col("window.start").alias("minute"), "n", "total")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS calls FROM events")
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a user within the last hour of each event."""
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    recent = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(recent).alias("calls"))
