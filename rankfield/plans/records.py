"""Run records, artifacts, requests, contracts and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.operators import records as R
from rankfield.plans.analogue import EVENTS_SQL, events
from rankfield.plans.registry import query
from rankfield.sources.tables import table

PATHS = ["summary.safe", "summary.robust", "test.exact"]


@query(
    """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10) / 10.0e0 END AS safe, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 7) / 10.0e0 END AS robust, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 4) / 10.0e0 END AS exact FROM orders)
        SELECT id, round(coalesce(safe, robust, exact), 9) AS rate, CASE WHEN safe IS NOT NULL THEN 'summary.safe' WHEN robust IS NOT NULL THEN 'summary.robust' WHEN exact IS NOT NULL THEN 'test.exact' END AS source,
            CASE WHEN id % 4 = 1 THEN 77 WHEN id % 3 <> 1 THEN id % 50 END::INT AS seed, CASE WHEN id % 4 = 1 THEN 'override' WHEN id % 3 <> 1 THEN 'config.seed' END AS seed_source FROM o"""
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric and a seed of each run by the precedence of their paths."""
    i = F.col("o_orderkey")
    document = F.to_json(F.struct(F.struct(F.when(i % 2 == 0, i % 10 / 10).alias("safe"), F.when(i % 3 == 0, i % 7 / 10).alias("robust")).alias("summary"), F.struct(F.when(i % 5 != 0, i % 4 / 10).alias("exact")).alias("test"), F.struct(F.when(i % 3 != 1, i % 50).alias("seed")).alias("config")))
    rows = table(spark, sf_dir, "orders").select(i.alias("id"), R.first_path(document, PATHS).alias("m"), R.seed_of(F.when(i % 4 == 1, "77"), document, ["config.seed"]).alias("s"))
    return rows.select("id", F.round("m.value", 9).alias("rate"), F.col("m.source").alias("source"), F.col("s.seed").alias("seed"), F.col("s.source").alias("seed_source"))


@query(
    """WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 <> 0 THEN md5(p_name) END AS s, p_size AS n FROM part WHERE p_partkey % 10 <> 1), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE md5(p_name) END AS s, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS n FROM part WHERE p_partkey % 11 <> 1)
        SELECT 'a' || k AS label, coalesce(a.s = b.s AND a.n = b.n, false) AS matched, CASE WHEN k % 10 = 1 OR k % 11 = 1 THEN 'missing_artifact' WHEN NOT coalesce(a.s = b.s AND a.n = b.n, false) THEN 'artifact_hash_mismatch' END AS difference FROM a FULL JOIN b USING (k)"""
)
def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of two runs by digest and size."""
    k, rows = F.col("p_partkey"), table(spark, sf_dir, "part")
    label, digest = F.concat(F.lit("a"), k).alias("label"), F.md5(F.col("p_name").cast("binary"))
    a = rows.filter(k % 10 != 1).select(label, F.when(k % 6 != 0, digest).alias("sha256"), F.col("p_size").alias("byte_size"))
    b = rows.filter(k % 11 != 1).select(label, F.when(k % 7 == 0, "x").otherwise(digest).alias("sha256"), F.when(k % 9 == 0, 0).otherwise(F.col("p_size")).alias("byte_size"))
    return R.artifact_checks(a, b)


@query(
    """WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '45%' WHEN 2 THEN '0.5' WHEN 3 THEN 'n/a' WHEN 4 THEN 'oops' ELSE '250' END AS v, p_partkey % 2 AS m FROM part),
        n AS (SELECT m, CASE WHEN v = '45%' THEN 0.45e0 WHEN v = '0.5' THEN 0.5e0 END AS x, CASE WHEN v IN ('45%', '0.5') THEN 'ok' WHEN v IS NULL OR v = 'n/a' THEN 'missing' ELSE 'abnormal' END AS s FROM v)
        SELECT CASE m WHEN 0 THEN 'hit_rate' ELSE 'gap' END AS metric, count(*) AS rows, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'abnormal') AS abnormal, round(avg(x), 9) AS mean, round(min(CASE m WHEN 0 THEN x ELSE 1 - x END), 9) AS least FROM n GROUP BY m"""
)
def metric_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as text by run, normalised and summed up; of one less is better."""
    k = F.col("p_partkey")
    value = F.get(F.array(F.lit(None).cast("string"), *[F.lit(v) for v in ("45%", "0.5", "n/a", "oops", "250")]), (k % 6).cast("int"))
    rows = table(spark, sf_dir, "part").select(k.alias("run_id"), (k % 10).alias("seed_index"), value.alias("value"))
    both = R.standard_rows(rows.filter("run_id % 2 = 0"), "hit_rate").unionByName(R.standard_rows(rows.filter("run_id % 2 = 1"), "gap", maximize=False))
    return R.metric_summary(both).withColumns({"mean": F.round("mean", 9), "least": F.round("least", 9)})


@query(
    """WITH r AS (SELECT p_partkey AS id, ['20240105', '2024-1-5', '20240230', '20991231', NULL][p_partkey % 5 + 1] AS d, p_size % 3 AS m FROM part)
        SELECT id, CASE WHEN d IS NULL OR d = '2024-1-5' THEN 'format' WHEN d = '20240230' THEN 'no such day' WHEN d = '20991231' THEN 'future' END AS date_issue, CASE WHEN d IS NOT NULL AND m = 0 THEN d WHEN d IS NULL AND m = 1 THEN '20240501' WHEN d IS NULL AND m = 2 THEN '20240401' END AS cutoff,
            CASE WHEN d IS NOT NULL AND m > 0 THEN 'both given' WHEN d IS NULL AND m = 0 THEN 'none given' END AS cutoff_issue, CASE WHEN id % 12 = 10 THEN CASE WHEN id % 24 = 10 THEN 'seeds must be distinct' END ELSE 'seeds must be ten' END AS seed_issue FROM r"""
)
def request_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with requested dates, cutoffs and seeds."""
    k, m = F.col("p_partkey"), F.col("p_size") % 3
    day = F.get(F.array(*[F.lit(v) for v in ("20240105", "2024-1-5", "20240230", "20991231")], F.lit(None).cast("string")), (k % 5).cast("int"))
    today = F.lit("2024-05-20").cast("date")
    seeds = F.transform(F.sequence(F.lit(1), (k % 12).cast("int")), lambda s: F.when((k % 24 == 10) & (s == 2), 1).otherwise(s))
    cut = R.cutoff(day, m, today)
    return table(spark, sf_dir, "part").select(k.alias("id"), R.request_issue(day, today).alias("date_issue"), cut["cutoff"].alias("cutoff"), cut["issue"].alias("cutoff_issue"), R.seed_issue(F.when(k % 12 > 0, seeds)).alias("seed_issue"))


@query(
    "WITH "
    + EVENTS_SQL
    + """ SELECT meet, sum(CASE race_id % 4 WHEN 0 THEN 0.95e0 WHEN 1 THEN 1.05e0 ELSE 1 END) AS speed, sum(CASE race_id % 4 WHEN 0 THEN 1.2e0 WHEN 1 THEN 0.9e0 ELSE 1 END) AS stamina, count(*) FILTER (race_id % 3 <> 0) AS with_card, count(*) FILTER (race_id % 5 <> 0) AS with_cancellations FROM events_v GROUP BY 1"""
)
def event_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of the track's condition, and which required sources events have."""
    i = F.col("race_id")
    effect = R.weather_effect(F.when(i % 4 == 0, "heavy").when(i % 4 == 1, "firm").when(i % 4 == 2, "good"))
    status = R.source_status({"card": F.when(i % 3 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))}, {"cancelled": F.when(i % 5 != 0, True)})
    rows = events(spark, sf_dir).select("meet", effect.alias("e"), status.alias("s"))
    return rows.groupBy("meet").agg(F.sum("e.speed").alias("speed"), F.sum("e.stamina").alias("stamina"), F.count(F.when(F.col("s")["card"] == "present", 1)).alias("with_card"), F.count(F.when(F.col("s")["cancelled"] == "present", 1)).alias("with_cancellations"))


@query(
    """WITH n AS (SELECT o_custkey AS chain, o_orderkey AS depth, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'passed' WHEN o_orderkey % 5 = 0 THEN 'blocked' WHEN o_custkey % 4 = 0 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'repair' END AS action FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY (status = 'passed')::INT, (action IS NULL)::INT, depth) AS k FROM n)
        SELECT chain, CASE WHEN status <> 'passed' THEN depth END AS depth, CASE WHEN status = 'passed' THEN 'implement_runner' ELSE coalesce(action, 'make_artifact-' || depth) END AS action FROM r WHERE k = 1"""
)
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chain of artifacts needs next."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    source = F.when(i % 3 == 0, "passed").when(i % 5 == 0, "blocked_by_source").when(c % 4 == 0, "passed").otherwise("error")
    nodes = table(spark, sf_dir, "orders").select(c.alias("chain"), i.alias("depth"), R.node_status(i % 7 != 0, source).alias("status"), F.when(i % 11 == 0, "repair").alias("action"), F.concat(F.lit("artifact-"), i).alias("artifact"))
    return R.next_action(nodes)


@query("WITH " + EVENTS_SQL + " SELECT CASE WHEN race_id % 3 = 0 THEN '20200101_x_' || race_id ELSE strftime(race_date, '%Y%m%d') || '_' || meet || '_' || race_id END AS race_id, CASE WHEN race_id % 3 = 0 THEN '20200101' ELSE strftime(race_date, '%Y%m%d') END AS date FROM events_v")
def live_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of live events, given or made, and their dates."""
    i = F.col("race_id")
    rows = events(spark, sf_dir).select(F.when(i % 3 == 0, F.concat(F.lit("20200101_x_"), i)).otherwise(F.lit(" ")).alias("race_id"), F.date_format("race_date", "yyyyMMdd").alias("date"), "meet", i.alias("number"))
    return R.live_scope(rows)


@query(
    """WITH c AS (SELECT 'f' || s AS feature_name, ['RELEASE', 'AUDIT_ONLY', 'BACKFILL_ONLY', 'RELEASE'][s % 4 + 1] AS release_bucket, s % 3 = 0 AS current FROM generate_series(0, 29) g(s)), s AS (SELECT DISTINCT 'f' || p_size AS feature_name FROM part)
        SELECT feature_name, release_bucket, (SELECT count(*) FROM c WHERE release_bucket = 'RELEASE') AS released, (SELECT count(*) FROM c WHERE release_bucket = 'RELEASE' AND current) AS current FROM c JOIN s USING (feature_name) WHERE release_bucket <> 'RELEASE'"""
)
def overlay_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected features that a release may not use, beside what it may."""
    i = F.col("id")
    bucket = F.get(F.array(*[F.lit(b) for b in ("RELEASE", "AUDIT_ONLY", "BACKFILL_ONLY", "RELEASE")]), (i % 4).cast("int"))
    contract = spark.range(30).select(F.concat(F.lit("f"), i).alias("feature_name"), bucket.alias("release_bucket"), F.when(i % 3 == 0, "current_model_input").otherwise("planned").alias("model_feature_status"))
    count = lambda rows, name: F.broadcast(rows.agg(F.count(F.lit(1)).alias(name)))
    found = R.overlay_violations(table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_size").alias("feature_name")), contract)
    return found.join(count(R.overlay_names(contract), "released")).join(count(R.overlay_names(contract, current_only=True), "current"))  # one row each


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE trim(p_brand) END AS brand, CASE p_partkey % 3 WHEN 0 THEN '12.0' WHEN 1 THEN 'x-7' END AS rate, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS says FROM part"""
)
def cleaned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail blocks trimmed and read as numbers, and whether their values say anything."""
    k = F.col("p_partkey")
    brand = F.when(k % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    rate = F.when(k % 3 == 0, "12%").when(k % 3 == 1, " x-7 ").otherwise("")
    block = F.create_map(F.lit("brand"), brand, F.lit("rate"), rate)
    says = R.meaningful(F.when(k % 7 != 0, F.lit("v")).otherwise(" "), k % 5 == 0, F.lit(0))
    return table(spark, sf_dir, "part").select(k.alias("id"), R.cleaned_map(block, numeric=False)["brand"].alias("brand"), R.cleaned_map(block, numeric=True)["rate"].alias("rate"), says.alias("says"))
