"""Timing audits, jobs, run journals, overlap selection and insight tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.operators import jobs as J
from rankfield.operators import journal as N
from rankfield.operators import overlap as O
from rankfield.operators import ranking as R
from rankfield.operators import timing as T
from rankfield.plans.analogue import ENTRIES_SQL, entries
from rankfield.plans.prediction import PREDICTIONS_SQL, outcomes
from rankfield.plans.registry import query
from rankfield.sources.tables import table

SNAPSHOTS_SQL = """
    snap_v AS (
        SELECT o_orderkey AS id, o_orderdate AS base, o_orderkey % 7 AS m, strftime(o_orderdate, '%Y%m%d') AS d,
            CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '2599' ELSE (900 + (o_orderkey % 9) * 100)::VARCHAR END AS t, o_orderkey % 5 <> 4 AS present, o_orderstatus AS st FROM orders),
    start_v AS (
        SELECT *, CASE WHEN t NOT IN ('', '2599') THEN strptime(d || lpad(t, 4, '0'), '%Y%m%d%H%M') - INTERVAL 9 HOUR END AS start FROM snap_v),
    meta_v AS (
        SELECT *, start - INTERVAL 10 MINUTE AS cutoff, CASE WHEN m = 1 THEN base END AS ov, CASE WHEN m = 2 THEN base + INTERVAL 30 HOUR END AS co, CASE WHEN m = 3 THEN base - INTERVAL 3 HOUR END AS rc, CASE WHEN m = 4 THEN base END AS ru FROM start_v),
    replay_v AS (
        SELECT *, coalesce(ov, co, rc, cutoff, ru) AS final, CASE WHEN ov IS NOT NULL THEN 'source_revision' WHEN coalesce(co, rc) IS NOT NULL THEN 'snapshot_collected_at' WHEN cutoff IS NOT NULL THEN 'derived_from_schedule' ELSE 'fallback_collected_only' END AS source FROM meta_v),
    status_v AS (
        SELECT *, CASE WHEN final IS NULL THEN 'missing_timestamp' WHEN NOT present THEN 'partial_snapshot' WHEN final > cutoff THEN 'late_snapshot_unusable'
            WHEN source IN ('source_revision', 'snapshot_collected_at') THEN 'strict' ELSE 'degraded' END AS replay FROM replay_v)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots with start times as text and some of the timestamps present."""
    base, key, m = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey"), F.col("o_orderkey") % 7
    text = F.when(key % 11 == 0, "").when(key % 13 == 0, "2599").otherwise((900 + (key % 9) * 100).cast("string"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        base.alias("base"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("d"),
        text.alias("t"),
        (key % 5 != 4).alias("present"),
        F.when(m == 1, base).alias("ov"),
        F.when(m == 2, base + F.expr("INTERVAL 30 HOURS")).alias("co"),
        F.when(m == 3, base - F.expr("INTERVAL 3 HOURS")).alias("rc"),
        F.when(m == 4, base).alias("ru"),
        F.col("o_orderstatus").alias("st"),
    )


def with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with their metadata."""
    rows = snapshots(spark, sf_dir)
    start = T.start_at(F.col("d"), F.col("t"))
    return rows.withColumn("meta", T.snapshot_metadata(F.col("ov"), F.col("co"), F.col("rc"), F.col("ru"), start, F.col("present")))


@query("WITH " + SNAPSHOTS_SQL + " SELECT source, replay, count(*) AS n, min(final)::VARCHAR AS first FROM status_v GROUP BY ALL")
def snapshot_replay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by timestamp source and replay status."""
    rows = with_meta(spark, sf_dir).groupBy(F.col("meta.source").alias("source"), F.col("meta.replay_status").alias("replay"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("meta.finalized_at").cast("string").alias("first"))


@query(
    "WITH "
    + SNAPSHOTS_SQL
    + """ SELECT CASE WHEN start IS NULL THEN CASE WHEN t = '' THEN 'missing_scheduled_start' ELSE 'invalid_scheduled_start' END WHEN co IS NULL AND ov IS NULL THEN 'missing_source_snapshot'
        WHEN coalesce(ov, co) > start - INTERVAL 30 MINUTE THEN 'source_after_cutoff' ELSE 'pass' END AS reason, count(*) AS n FROM meta_v GROUP BY 1"""
)
def release_cutoff_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots by whether they are usable thirty minutes before the start."""
    reason = T.release_cutoff(F.col("d"), F.col("t"), F.coalesce("ov", "co"))
    return snapshots(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + SNAPSHOTS_SQL
    + """, e AS (SELECT l_orderkey AS id, list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag <> 'R') AS active, list(l_linenumber ORDER BY l_extendedprice DESC, l_linenumber, l_partkey)[1:3] AS top3 FROM lineitem GROUP BY 1),
        j AS (SELECT s.*, coalesce(active, []) AS active, coalesce(top3, []) AS top3 FROM status_v s LEFT JOIN e USING (id))
        SELECT coalesce(CASE WHEN st <> 'F' THEN 'missing_result_data' WHEN replay NOT IN ('strict', 'degraded') THEN replay WHEN len(active) < 3 THEN 'insufficient_active_runners'
            WHEN len(top3) <> 3 OR len(list_distinct(top3)) <> 3 THEN 'invalid_top3_result' WHEN NOT list_has_all(active, top3) THEN 'top3_not_in_active_runners' END, 'included') AS reason, count(*) AS n FROM j GROUP BY 1"""
)
def holdout_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by why they are kept out of the holdout."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("active"),
        F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c")))).alias("_t"),
    )
    lines = lines.select("id", "active", F.transform(F.slice("_t", 1, 3), lambda x: x["b"]).alias("top3"))
    none = F.array().cast("array<int>")
    rows = with_meta(spark, sf_dir).join(lines, "id", "left")
    active, top3 = F.coalesce(F.col("active").cast("array<int>"), none), F.coalesce(F.col("top3").cast("array<int>"), none)
    status = F.when(F.col("st") == "F", "collected").otherwise("pending")
    reason = T.holdout_exclusion(status, F.lit(True), F.col("meta"), active, top3, F.lit(False))
    return rows.groupBy(F.coalesce(reason, F.lit("included")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


JOBS_SQL = """
    jobs_v AS (
        SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'collect_race' WHEN 'purchase' THEN 'batch_collect' WHEN 'view' THEN 'enrichment' WHEN 'click' THEN 'full_pipeline' ELSE 'odd' END AS type,
            CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' ELSE 'strange' END AS status FROM events),
    kinds_v AS (
        SELECT *, CASE type WHEN 'collect_race' THEN 'collection' WHEN 'batch_collect' THEN 'batch' WHEN 'enrichment' THEN 'enrichment' WHEN 'full_pipeline' THEN 'batch' ELSE type END AS kind,
            CASE status WHEN 'running' THEN 'processing' ELSE status END AS state FROM jobs_v)"""


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs with aliased kinds and states."""
    kinds = {"signup": "collect_race", "purchase": "batch_collect", "view": "enrichment", "click": "full_pipeline"}
    states = ["pending", "queued", "running", "completed", "failed", "strange"]
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.coalesce(J.coded(F.col("event_type"), kinds), F.lit("odd")).alias("type"), F.array(*[F.lit(s) for s in states])[(F.col("event_id") % 6).cast("int")].alias("status")
    )
    return rows.select("*", J.shadow(F.col("type"), J.job_kind(F.col("type"))).alias("kind"), J.shadow(F.col("status"), J.lifecycle(F.col("status"))).alias("state"))


@query(
    "WITH "
    + JOBS_SQL
    + """ SELECT kind, state, count(*) AS n, round(avg(CASE state WHEN 'completed' THEN 100 WHEN 'queued' THEN 5 WHEN 'processing' THEN CASE WHEN type = 'full_pipeline' THEN 10 + 30 * (event_id % 4) ELSE 50 END ELSE 0 END), 6) AS progress,
        count(*) FILTER (state IN ('completed', 'failed')) AS terminal FROM kinds_v GROUP BY ALL"""
)
def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by kind and state, their progress and terminal counts."""
    progress = J.progress(F.col("state"), F.col("type"), F.col("event_id") % 4)
    rows = job_rows(spark, sf_dir).groupBy("kind", "state")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(progress), 6).alias("progress"), F.count(F.when(J.cancelled(F.col("state")) != "cancelled", 1)).alias("terminal"))


@query("WITH " + JOBS_SQL + " SELECT event_id, kind, count(*) OVER () AS total FROM kinds_v WHERE state = 'failed' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def job_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of failed jobs with the number of all of them; the count is a separate aggregate, not a window over all rows."""
    rows = job_rows(spark, sf_dir).filter("state = 'failed'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("ts"), "event_id").offset(50).limit(25)
    return page.join(F.broadcast(total)).select("event_id", "kind", "total")


@query("WITH " + JOBS_SQL + " SELECT kind, count(*) AS n FROM kinds_v WHERE NOT (state IN ('completed', 'failed') AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY) GROUP BY 1")
def job_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after old terminal jobs are removed."""
    rows = job_rows(spark, sf_dir)
    newest = rows.agg(F.max("ts").alias("newest"))
    old = F.col("state").isin(J.TERMINAL) & (F.col("ts") < F.col("newest") - F.expr("INTERVAL 10 DAYS"))
    return rows.join(F.broadcast(newest)).filter(~old).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT i + 1 AS seed_index, 40 + i AS seed, printf('seed_%02d_rs%d', i + 1, 40 + i) AS run_id FROM generate_series(0, 9) g(i)),
        r AS (SELECT printf('seed_%02d_rs%d', k + 1, 40 + k) AS run_id, 'completed' AS status, avg(l_discount) AS rate FROM (SELECT *, l_suppkey % 10 AS k FROM lineitem) WHERE k <> 3 GROUP BY k),
        j AS (SELECT seed_index, e.run_id, coalesce(status, 'missing') AS status, rate FROM e LEFT JOIN r USING (run_id)),
        f AS (SELECT quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.75) AS q3 FROM j)
        SELECT seed_index::INT AS seed_index, run_id, status, round(rate, 6) AS rate, CASE WHEN rate < q1 - 0.1 * (q3 - q1) THEN 'low' WHEN rate > q3 + 0.1 * (q3 - q1) THEN 'high' END AS outlier FROM j, f"""
)
def seed_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected runs with their records and outlier labels."""
    expected = N.execution_matrix(spark, list(range(40, 50)))
    k = F.col("l_suppkey") % 10
    runs = table(spark, sf_dir, "lineitem").filter(k != 3).groupBy(k.alias("k")).agg(F.avg("l_discount").alias("rate"))
    runs = runs.select(F.format_string("seed_%02d_rs%d", F.col("k") + 1, F.col("k") + 40).alias("run_id"), F.lit("completed").alias("status"), "rate")
    rows = N.with_outliers(N.expected_rows(expected, runs), "rate", 0.1)
    return rows.select("seed_index", "run_id", "status", F.round("rate", 6).alias("rate"), "outlier")


@query(
    """WITH a AS (SELECT c_custkey AS k, c_name AS x, c_nationkey AS y FROM customer WHERE c_custkey % 10 <> 1),
        b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_name || '!' ELSE c_name END AS x, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS y FROM customer WHERE c_custkey % 10 <> 2),
        j AS (SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' WHEN a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y THEN 'matched' ELSE 'mismatched' END AS state,
            CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN concat_ws(',', CASE WHEN a.x IS DISTINCT FROM b.x THEN 'x' END, CASE WHEN a.y IS DISTINCT FROM b.y THEN 'y' END) ELSE '' END AS fields FROM a FULL JOIN b USING (k))
        SELECT state, fields, count(*) AS n FROM j GROUP BY ALL"""
)
def result_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result sets: matched, mismatched by field, missing, unexpected."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("x"), F.col("c_nationkey").alias("y"))
    other = rows.filter("k % 10 <> 2").select("k", F.when(F.col("k") % 4 == 0, F.concat("x", F.lit("!"))).otherwise(F.col("x")).alias("x"), F.when(F.col("k") % 6 != 0, F.col("y")).alias("y"))
    found = N.compare(rows.filter("k % 10 <> 1"), other, "k", ["x", "y"])
    return found.groupBy("state", F.array_join("differing", ",").alias("fields")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(c_custkey) FILTER (c_custkey >= 701) AS first_difference, count(*) AS reference_length, count(*) FILTER (c_custkey <= 1200) AS other_length FROM customer")
def sequence_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First position at which two sequences differ."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    other = rows.filter("c_custkey <= 1200").select("c_custkey", F.when(F.col("c_custkey") < 701, F.col("c_name")).otherwise("other").alias("c_name"))
    return N.first_sequence_difference(rows, other, "c_custkey", "c_name")


@query(
    "WITH "
    + ENTRIES_SQL
    + """, c AS (SELECT race_id, entry_no, rating, discount, pos, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, entry_no) AS a, row_number() OVER (PARTITION BY race_id ORDER BY rating DESC, entry_no) AS b,
            row_number() OVER (PARTITION BY race_id ORDER BY discount DESC, entry_no) AS d, row_number() OVER (PARTITION BY race_id ORDER BY burden, discount, entry_no) AS e FROM entries_v),
        l AS (SELECT race_id, v, list_sort(list(entry_no)) AS combo FROM (SELECT race_id, entry_no, unnest([1, 2, 3, 4]) AS v, unnest([a, b, d, e]) AS r FROM c) WHERE r <= 3 GROUP BY ALL),
        k AS (SELECT race_id, combo, count(*) AS support, sum(1.0::DOUBLE / (v + 1)) AS score FROM l WHERE len(combo) = 3 GROUP BY ALL),
        f AS (SELECT race_id, combo AS fallback FROM l WHERE v = 1 AND len(combo) = 3),
        w AS (SELECT *, score + support / 4 AS w FROM k),
        i AS (SELECT race_id, item, sum(w) AS iw FROM (SELECT race_id, unnest(combo) AS item, w FROM w) GROUP BY ALL),
        p AS (SELECT race_id, x, y, sum(w) AS pw FROM (SELECT race_id, combo[1] AS x, combo[2] AS y, w FROM w UNION ALL SELECT race_id, combo[1], combo[3], w FROM w UNION ALL SELECT race_id, combo[2], combo[3], w FROM w) GROUP BY ALL),
        n AS (SELECT k.race_id, combo, support, score, list_filter(combo, lambda q: NOT list_contains(fallback, q))[1] AS added, list_filter(fallback, lambda q: NOT list_contains(combo, q))[1] AS dropped, list_sort(list_intersect(combo, fallback)) AS kept
            FROM k JOIN f ON k.race_id = f.race_id WHERE len(list_intersect(combo, fallback)) = 2),
        t AS (SELECT n.*, round(score + 0.5 * coalesce(ia.iw, 0) - 0.25 * coalesce(id.iw, 0) + 0.1 * coalesce(pw, 0), 9) AS total FROM n LEFT JOIN i ia ON ia.race_id = n.race_id AND ia.item = added
            LEFT JOIN i id ON id.race_id = n.race_id AND id.item = dropped LEFT JOIN p ON p.race_id = n.race_id AND x = kept[1] AND y = kept[2]),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY total DESC, support DESC, combo) AS rn FROM t) WHERE rn = 1),
        s AS (SELECT f.race_id, fallback, b.combo AS best, total, coalesce(k.score, 0) AS own FROM f LEFT JOIN b USING (race_id) LEFT JOIN k ON k.race_id = f.race_id AND k.combo = fallback)
        SELECT race_id, list_aggregate(CASE WHEN coalesce(total >= own + 0.2, false) THEN best ELSE fallback END, 'string_agg', '-') AS chosen, coalesce(total >= own + 0.2, false) AS switched,
            round(CASE WHEN coalesce(total >= own + 0.2, false) THEN total ELSE own END, 6) AS score FROM s"""
)
def overlap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations that share two entries with the fallback and beat it."""
    rows = R.gathered(entries(spark, sf_dir), "race_id", "entry_no", ["entry_no", "price", "rating", "discount", "burden"])
    orders = [[("price", True)], [("rating", True)], [("discount", True)], [("burden", False), ("discount", False)]]
    combos = F.array(*[O.combination_key(R.first_items(F.col("all"), "entry_no", O.ITEMS, *keys)) for keys in orders])
    rows = rows.select("race_id", combos.alias("combos"))
    votes = lambda c: F.filter(F.transform("combos", lambda x, i: F.when(x == c, 1.0 / (i + 2))), lambda x: x.isNotNull())
    candidate = lambda c: F.struct(c.alias("combo"), F.aggregate(votes(c), F.lit(0.0), lambda s, x: s + x).alias("score"), F.size(votes(c)).alias("support"))
    voted = rows.select("race_id", F.col("combos")[0].alias("fallback"), F.transform(F.array_distinct(F.array_compact("combos")), candidate).alias("candidates")).filter("fallback IS NOT NULL")
    found = O.chosen_overlapping(voted, len(orders), 0.5, 0.25, 0.1, 0.2)
    return found.select("race_id", F.array_join(F.col("chosen").cast("array<string>"), "-").alias("chosen"), "switched", F.round("score", 6).alias("score"))


@query(
    "WITH "
    + PREDICTIONS_SQL
    + """, x AS (SELECT o.race_id, hit_count, field_size, unnest(predicted) AS entry_no FROM outcome_v o), k AS (SELECT race_id, entry_no, row_number() OVER (PARTITION BY race_id ORDER BY win_odds, pos) AS r FROM entries_v WHERE win_odds > 0),
        g AS (SELECT x.race_id, any_value(hit_count) AS hits, any_value(field_size) AS size, bool_and(coalesce(r <= 3, false)) AS favourites, bool_and(coalesce(r >= 7, false)) AS outsiders, sum(coalesce(r, 99)) AS total FROM x LEFT JOIN k ON x.race_id = k.race_id AND x.entry_no = k.entry_no GROUP BY 1)
        SELECT CASE WHEN hits = 3 THEN 'success' WHEN hits = 0 THEN 'failure' ELSE 'partial' END AS bucket, CASE WHEN favourites THEN 'favourite_bias' WHEN size > 12 THEN 'large_field' ELSE 'other' END AS category,
            CASE WHEN total <= 3 THEN 'favourites' WHEN total <= 5 THEN 'balanced' ELSE 'outsiders' END AS strategy, count(*) AS n, count(*) FILTER (outsiders) AS all_outsiders FROM g GROUP BY ALL"""
)
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by result, kind of failure and the odds ranks of the picks."""
    ranks = entries(spark, sf_dir).filter("win_odds > 0").select("race_id", "entry_no", F.row_number().over(Window.partitionBy("race_id").orderBy("win_odds", "pos")).alias("r"))
    picks = outcomes(spark, sf_dir).select("race_id", "hit_count", "field_size", F.explode("predicted").alias("entry_no"))
    low, high = F.coalesce(F.col("r") <= 3, F.lit(False)), F.coalesce(F.col("r") >= 7, F.lit(False))
    per = picks.join(ranks, ["race_id", "entry_no"], "left").groupBy("race_id").agg(
        F.first("hit_count").alias("hits"), F.first("field_size").alias("size"), F.min(low).alias("favourites"), F.min(high).alias("outsiders"), F.sum(F.coalesce("r", F.lit(99))).alias("total")
    )
    bucket = F.when(F.col("hits") == 3, "success").when(F.col("hits") == 0, "failure").otherwise("partial")
    category = F.when(F.col("favourites"), "favourite_bias").when(F.col("size") > 12, "large_field").otherwise("other")
    strategy = F.when(F.col("total") <= 3, "favourites").when(F.col("total") <= 5, "balanced").otherwise("outsiders")
    return per.groupBy(bucket.alias("bucket"), category.alias("category"), strategy.alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outsiders"), 1)).alias("all_outsiders"))
