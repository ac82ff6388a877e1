"""Cleaning functions, codes, rates, names and field policies over dirty values, each beside the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.functions import clean, rates
from rankfield.operators import decisions as D
from rankfield.operators import jobs as J
from rankfield.operators import journal as N
from rankfield.operators import policy as P
from rankfield.operators import ranking as R
from rankfield.operators.leakage import RESULT_FIELDS, SECTIONAL
from rankfield.plans.registry import query
from rankfield.sources.tables import table

VALUES = ["  7 ", "007.0", "-", "12%", "1.5 kg", "abc", "", "2024-01-05", "20240105", "(+5)", "건조 (12%)", "inf", "-3", "NaN", "480(+5)", "n/a", "0", "512(-77)", "-2.5x", " 미상 ", "20240105-1-7"]
NAMES = ["hrNo", "rcCntT", "ord1CntT", "jkBirthday", "wgHr", "HTTPServer", "plain"]
_LIST = "[" + ", ".join(f"'{v}'" for v in VALUES) + "]"
DIRTY_SQL = f"""WITH d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 23 < {len(VALUES)} THEN {_LIST}[p_partkey % 23 + 1] END AS v FROM part),
    n AS (SELECT *, nullif(trim(v), '') AS t, CASE WHEN isfinite(try_cast(trim(v) AS DOUBLE)) THEN try_cast(trim(v) AS DOUBLE) END AS num FROM d),
    s AS (SELECT *, CASE WHEN lower(t) NOT IN ('-', '--', '없음', '미상', 'n/a', 'na') THEN t END AS plain, try_cast(replace(v, '%', '') AS DOUBLE) AS pct FROM n) """


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.get(F.array(*[F.lit(v) for v in VALUES]), (F.col("p_partkey") % 23).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick.alias("v"))


@query(
    DIRTY_SQL
    + r"""SELECT id, t AS text, num AS number, trunc(num)::INT AS whole, CASE WHEN num > 0 THEN num END AS positive, CASE WHEN trunc(num) >= 0 THEN trunc(num)::INT END AS nonnegative, coalesce(t, 'none') AS first_present,
            nullif(regexp_replace(t, '\.0$', ''), '') AS identifier, plain AS sentinel, CASE WHEN length(regexp_replace(plain, '\D', '', 'g')) = 8 THEN regexp_replace(plain, '\D', '', 'g') END AS date_digits,
            CASE WHEN length(regexp_replace(v, '\D', '', 'g')) >= 8 THEN substr(regexp_replace(v, '\D', '', 'g'), 1, 8) ELSE '19990101' END AS date_prefix, try_cast(regexp_extract(v, '(\d+)', 1) AS INT) AS first_digits,
            CASE WHEN try_cast(regexp_extract(v, '\(([+-]?\d+)\)', 1) AS INT) BETWEEN -40 AND 40 THEN try_cast(regexp_extract(v, '\(([+-]?\d+)\)', 1) AS DOUBLE) END AS delta,
            try_cast(regexp_extract(v, '\((\d+)%\)', 1) AS DOUBLE) AS percent, try_cast(regexp_extract(v, '^(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS leading_number, CASE WHEN isfinite(pct) AND pct >= 0 THEN pct END AS nonnegative_number FROM s"""
)
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of dirty values side by side."""
    v = F.col("v")
    return dirty(spark, sf_dir).select(
        "id",
        clean.text(v).alias("text"),
        clean.number(v).alias("number"),
        clean.whole(v).alias("whole"),
        clean.positive(clean.number(v)).alias("positive"),
        clean.nonnegative(clean.whole(v)).alias("nonnegative"),
        clean.first_present(v, F.lit("none")).alias("first_present"),
        clean.identifier(v).alias("identifier"),
        clean.sentinel_to_null(v).alias("sentinel"),
        clean.date_digits(v).alias("date_digits"),
        clean.date_prefix(v, F.lit("1999-01-01")).alias("date_prefix"),
        clean.first_digits(v).alias("first_digits"),
        clean.bounded_delta(v).alias("delta"),
        clean.percent_in_parentheses(v).alias("percent"),
        clean.leading_number(v).alias("leading_number"),
        clean.nonnegative_number(v).alias("nonnegative_number"),
    )


@query(
    r"""WITH c AS (SELECT p_partkey AS id, ['맑음', '흐림', '비', '눈', '안개'][p_partkey % 5 + 1] AS w, ['마령', '별정A', '별정B', '핸디캡', ''][p_partkey % 5 + 1] AS b, ['국6등급', '국4등급', '2등급', '혼OPEN', 'x'][p_partkey % 5 + 1] AS k,
            ['low', 'medium', 'high', 'none'][p_partkey % 4 + 1] AS r, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS f, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE '2024010' || (p_partkey % 9 + 1) END AS d, ['930', '1405', '2560', 'x'][p_partkey % 4 + 1] AS s FROM part)
        SELECT id, CASE w WHEN '맑음' THEN 0e0 WHEN '흐림' THEN 1 WHEN '비' THEN 2 WHEN '눈' THEN 3 END AS weather, CASE b WHEN '마령' THEN 0e0 WHEN '별정A' THEN 1 WHEN '별정B' THEN 2 WHEN '핸디캡' THEN 3 END AS budam,
            CASE k WHEN '국6등급' THEN 1e0 WHEN '국4등급' THEN 3 WHEN '2등급' THEN 5 WHEN '혼OPEN' THEN 7 END AS class, CASE r WHEN 'low' THEN 0e0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS rest, f::INT::DOUBLE AS flag,
            strftime(CASE s WHEN '930' THEN strptime(d || '0930', '%Y%m%d%H%M') WHEN '1405' THEN strptime(d || '1405', '%Y%m%d%H%M') END - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS starts FROM c"""
)
def coded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of categories, flags, and start times in UTC."""
    k = F.col("p_partkey")
    of = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    day = F.when(k % 6 != 0, F.concat(F.lit("2024010"), k % 9 + 1))
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        clean.coded(of("맑음", "흐림", "비", "눈", "안개"), clean.WEATHER_CODES).alias("weather"),
        clean.coded(of("마령", "별정A", "별정B", "핸디캡", ""), clean.BURDEN_CODES).alias("budam"),
        clean.coded(of("국6등급", "국4등급", "2등급", "혼OPEN", "x"), clean.CLASS_CODES).alias("class"),
        clean.coded(of("low", "medium", "high", "none"), clean.REST_RISK_CODES).alias("rest"),
        clean.flag_number(F.when(k % 3 == 0, True).when(k % 3 == 1, False)).alias("flag"),
        F.date_format(clean.start_at(day, of("930", "1405", "2560", "x")), "yyyy-MM-dd HH:mm:ss").alias("starts"),
    )


@query(
    """WITH n(name, snake) AS (VALUES ('hrNo', 'hr_no'), ('rcCntT', 'rc_cnt_t'), ('ord1CntT', 'ord1_cnt_t'), ('jkBirthday', 'jk_birthday'), ('wgHr', 'wg_hr'), ('HTTPServer', 'http_server'), ('plain', 'plain')),
        c AS (SELECT p_partkey AS id, name, snake, string_split(snake, '_') AS parts FROM part JOIN n ON name = ['hrNo', 'rcCntT', 'ord1CntT', 'jkBirthday', 'wgHr', 'HTTPServer', 'plain'][p_partkey % 7 + 1])
        SELECT id, snake, parts[1] || array_to_string(list_transform(parts[2:], lambda x: upper(x[1]) || lower(x[2:])), '') AS camel FROM c"""
)
def name_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in either style."""
    name = F.get(F.array(*[F.lit(v) for v in NAMES]), (F.col("p_partkey") % 7).cast("int"))
    snake = clean.camel_to_snake(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), snake.alias("snake"), clean.snake_to_camel(snake).alias("camel"))


@query(
    """WITH c AS (SELECT p_partkey AS id, p_size % 4 AS a, p_size % 3 AS b, CASE WHEN p_partkey % 5 <> 0 THEN p_size % 2 END AS c, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 9 END AS n, p_size % 6 AS y, p_size AS t FROM part)
        SELECT id, round(CASE WHEN n <> 0 THEN (a + b + c) / n END, 9) AS rate, round(CASE WHEN n > 0 THEN (a + b + coalesce(c, 0)) / n ELSE 0 END, 9) AS rate_or_zero, round((a + b) / (t + 15), 9) AS total, round(CASE WHEN y > 0 THEN a / (y + 2) ELSE (a + b) / (t + 15) END, 9) AS year FROM c"""
)
def rate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place rates where missing counts matter, where they are zero, and smoothed ones."""
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b, c, n = s % 4, s % 3, F.when(k % 5 != 0, s % 2), F.when(k % 7 != 0, s % 9)
    nine = lambda x, name: F.round(x, 9).alias(name)
    return table(spark, sf_dir, "part").select(
        k.alias("id"), nine(rates.place_rate(a, b, c, n), "rate"), nine(rates.place_rate_or_zero(a, b, c, n), "rate_or_zero"),
        nine(rates.total_place_rate(a + b, s), "total"), nine(rates.year_place_rate(a, s % 6, a + b, s), "year"),
    )


@query(
    """WITH c AS (SELECT event_id AS id, event_type AS t, event_id % 600 AS code, event_id % 2 = 0 AS a, event_id % 3 <> 0 AS b, event_id % 5 = 0 AS c, event_id % 7 < 3 AS d FROM events)
        SELECT id, CASE WHEN code < 400 THEN 'success' ELSE 'failure' END AS outcome, CASE t WHEN 'view' THEN 'collect_race' WHEN 'click' THEN 'full_pipeline' WHEN 'purchase' THEN 'batch_collect' END AS action,
            a AND b AND (c OR d) AS strict, b AND (a::INT + c::INT + d::INT) >= 2 AS votes FROM c"""
)
def outcomes_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of calls, actions of job words, and whether a challenger replaces the champion."""
    i = F.col("event_id")
    word = F.when(F.col("event_type") == "view", "collection").when(F.col("event_type") == "click", "full_pipeline").when(F.col("event_type") == "purchase", "batch").otherwise("unknown")
    tests = (i % 2 == 0, i % 3 != 0, i % 5 == 0, i % 7 < 3)
    return table(spark, sf_dir, "events").select(
        i.alias("id"), J.usage_outcome(i % 600).alias("outcome"), J.dispatch_action(word).alias("action"), N.promotion_gate(True, *tests).alias("strict"), N.promotion_gate(False, *tests).alias("votes")
    )


@query(
    """WITH c AS (SELECT p_partkey AS id, [p_partkey % 5, p_size % 5, p_partkey % 5] AS a, [p_size % 4 + 1, p_partkey % 7, 9, p_size % 5] AS b FROM part), u AS (SELECT id, unnest(a || b) AS x, generate_subscripts(a || b, 1) AS i FROM c),
        f AS (SELECT id, x, min(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM f)
        SELECT id, string_agg(x::VARCHAR, ',' ORDER BY n) AS merged FROM r WHERE n <= 3 GROUP BY 1"""
)
def ordered_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three distinct items of one list, then of the other."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    merged = R.ordered_union(F.array(k % 5, s % 5, k % 5), F.array(s % 4 + 1, k % 7, F.lit(9).cast("long"), s % 5), 3)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(merged.cast("array<string>"), ",").alias("merged"))


RULES = [P.Rule("race.date", "ALLOW"), P.Rule("horses[].rank", "LABEL_ONLY"), P.Rule("horses[].hr.*", "ALLOW_STORED_ONLY"), P.Rule("horses[].hr.prize", "HOLD"), P.Rule("meta.*", "META_ONLY")]
FORBIDDEN = rf"^({'|'.join(RESULT_FIELDS)})$|{SECTIONAL}|^finish_time$"


@query(
    r"""WITH p(path, flag) AS (VALUES ('race.date', 'ALLOW'), ('horses[].no', 'ALLOW'), ('horses[].rank', 'LABEL_ONLY'), ('horses[].hr.starts', 'ALLOW_STORED_ONLY'), ('horses[].hr.prize', 'HOLD'), ('horses[].sjG1fOrd', 'BLOCK'), ('horses[].payout', 'BLOCK'), ('meta.source', 'META_ONLY'))
        SELECT flag, string_agg(path, ',' ORDER BY path) AS fields, flag IN ('ALLOW', 'ALLOW_STORED_ONLY', 'ALLOW_SNAPSHOT_ONLY') AS operational, flag IN ('ALLOW', 'ALLOW_STORED_ONLY', 'ALLOW_SNAPSHOT_ONLY', 'HOLD', 'LABEL_ONLY') AS training, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS documents FROM p GROUP BY flag"""
)
def field_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of documents made of lines by their flags, and which a consumer may read."""
    detail = F.struct(F.col("l_suppkey").alias("starts"), F.col("l_extendedprice").alias("prize"))
    horse = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("rank"), detail.alias("hr"), F.col("l_quantity").alias("sjG1fOrd"), F.col("l_tax").alias("payout"))
    first = lambda c, name: F.struct(F.first(c).alias(name))
    documents = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first("l_shipdate", "date").alias("race"), F.collect_list(horse).alias("horses"), first("l_linestatus", "source").alias("meta"))
    report = P.policy_report(documents.drop("l_orderkey"), RULES, FORBIDDEN)
    allowed = lambda *options: F.col("flag").isin([f for f in ("ALLOW", "ALLOW_STORED_ONLY", "ALLOW_SNAPSHOT_ONLY", "HOLD", "LABEL_ONLY", "META_ONLY", "BLOCK") if P.is_allowed(f, *options)])
    counted = documents.agg(F.count(F.lit(1)).alias("documents"))
    return report.select("flag", F.array_join("fields", ",").alias("fields"), allowed().alias("operational"), allowed("hold", "label").alias("training")).join(F.broadcast(counted))  # one row


@query(
    """SELECT o_orderkey AS id, '[{"no":' || o_custkey % 9 || ',"hr":{"starts":' || o_custkey % 7 || '}}]' AS horses, 'date' AS race FROM orders"""
)
def pruned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the allowed leaves only, nested ones included."""
    horse = F.struct((F.col("o_custkey") % 9).alias("no"), F.lit(1).alias("rank"), F.struct((F.col("o_custkey") % 7).alias("starts"), F.lit(2.5).alias("prize")).alias("hr"), F.lit(3).alias("finish_time"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.lit("x").alias("date")).alias("race"), F.array(horse).alias("horses"), F.struct(F.lit("s").alias("source")).alias("meta"))
    kept = P.filter_columns(rows, RULES, FORBIDDEN)
    return kept.select("id", F.to_json("horses").alias("horses"), F.lit(",".join(kept.schema["race"].dataType.names)).alias("race"))


@query(
    """WITH d AS (SELECT DISTINCT unnest(['win_odds', 'name', 'blocks.rank', 'blocks.note', 'horses[].no']) AS path), t AS (SELECT path, CASE path WHEN 'win_odds' THEN 'hold' WHEN 'blocks.rank' THEN 'post_entry_only' WHEN 'horses[].no' THEN 'pre_entry_allowed' ELSE 'stored_only' END AS tag FROM d)
        SELECT path, tag, (SELECT count(*) FROM orders) AS documents FROM t"""
)
def tagged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of JSON documents with its tag from a contract, unknown ones with the default."""
    from rankfield.sources.documents import leaf_paths

    document = F.to_json(F.struct(F.lit(1.5).alias("win_odds"), F.lit("n").alias("name"), F.struct(F.lit(1).alias("rank"), F.lit("x").alias("note")).alias("blocks"), F.array(F.struct(F.lit(1).alias("no")), F.struct(F.lit(2).alias("no"))).alias("horses")))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), document.alias("doc"))
    contract = spark.createDataFrame([("win_odds", "hold"), ("blocks.rank", "post_entry_only"), ("horses[].no", "pre_entry_allowed"), ("other", "x")], "path string, tag string")
    return P.tagged_paths(leaf_paths(docs, "id", "doc"), contract, "stored_only").groupBy("path", "tag").agg(F.count(F.lit(1)).alias("documents"))


_WORDS = {
    "consumer_scope": "CASE p_partkey % 9 WHEN 0 THEN 'label_only' WHEN 1 THEN NULL ELSE 'train_inference' END",
    "train_inference_flag": "CASE p_size % 10 WHEN 0 THEN 'HOLD' WHEN 1 THEN 'LABEL_ONLY' WHEN 2 THEN 'ALLOW_SNAPSHOT_ONLY' WHEN 3 THEN 'ALLOW_SNAPSHOT_ONLY' WHEN 4 THEN 'ALLOW_STORED_ONLY' WHEN 5 THEN 'ALLOW_STORED_ONLY' WHEN 6 THEN 'BLOCK' ELSE 'ALLOW' END",
    "availability_stage": "CASE WHEN p_partkey % 31 = 0 THEN 'L+1' WHEN p_partkey % 29 = 0 THEN '?' WHEN p_size % 10 IN (2, 3) THEN 'L0 snapshot' WHEN p_partkey % 23 = 0 THEN NULL ELSE 'L0' END",
    "as_of_requirement": "CASE WHEN p_size % 10 IN (2, 3) THEN 'PRE_CUTOFF_SNAPSHOT' WHEN p_size % 10 IN (4, 5) THEN 'STORED_AS_OF_SNAPSHOT' ELSE 'DIRECT_PRE_RACE' END",
    "time_boundary_rule": "CASE WHEN p_size % 10 IN (2, 3) THEN 'SNAPSHOT_CAPTURED_AT_OR_BEFORE_ENTRY_FINALIZED_AT' WHEN p_size % 10 = 4 THEN 'STORED_ROW_AT_OR_BEFORE_ENTRY_FINALIZED_AT' ELSE 'VALUE_AT_OR_BEFORE_ENTRY_FINALIZED_AT' END",
    "generated_at_kind": "CASE WHEN p_partkey % 37 = 0 THEN 'POSTRACE_CONFIRMATION_TIME' ELSE 'SOURCE_PUBLICATION_TIME' END",
    "updated_at_kind": "CASE WHEN p_partkey % 41 = 0 THEN 'UNVERIFIED_TIME' ELSE 'SOURCE_PUBLICATION_TIME' END",
    "identifier_pattern": "CASE WHEN p_partkey % 43 = 0 THEN ' ' ELSE p_name END",
}
_TAG = "CASE WHEN p_partkey % 47 = 0 THEN 'post_entry_only' WHEN p_partkey % 53 = 0 THEN 'hold' ELSE 'pre_entry_allowed' END"


@query(
    f"""WITH w AS (SELECT p_brand AS field_path, {", ".join(f"{e} AS {c}" for c, e in _WORDS.items())}, {_TAG} AS tag FROM part),
        d AS (SELECT field_path, CASE
            WHEN train_inference_flag = 'BLOCK' OR coalesce(availability_stage = 'L+1', false) OR generated_at_kind = 'POSTRACE_CONFIRMATION_TIME' OR tag = 'post_entry_only' THEN 'block_postrace_or_leakage_signal'
            WHEN coalesce(consumer_scope, '') <> 'train_inference' THEN 'block_non_feature_scope'
            WHEN train_inference_flag = 'HOLD' OR coalesce(availability_stage = '?', false) OR updated_at_kind = 'UNVERIFIED_TIME' OR tag = 'hold' THEN 'review_unverified_timing_signal'
            WHEN trim(identifier_pattern) = '' OR (train_inference_flag = 'ALLOW' AND coalesce(availability_stage, '') <> 'L0') OR (train_inference_flag = 'ALLOW_STORED_ONLY' AND time_boundary_rule = 'VALUE_AT_OR_BEFORE_ENTRY_FINALIZED_AT') THEN 'review_inconsistent_allowed_contract'
            WHEN starts_with(train_inference_flag, 'ALLOW') AND availability_stage IS NOT NULL THEN 'allow_explicit_prerace_contract' ELSE 'review_fallback_incomplete_schema' END AS reason FROM w)
        SELECT reason, count(*) AS rows, count(DISTINCT field_path) AS fields FROM d GROUP BY 1"""
)
def schema_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of a registry allow, block or need a review of a field, and why."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("field_path"), *[F.expr(e).alias(c) for c, e in _WORDS.items()], F.array(F.expr(_TAG)).alias("tags"))
    return rows.select("field_path", D.decision().alias("d")).groupBy("d.reason").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("field_path").alias("fields"))


@query(
    """WITH c AS (SELECT p_brand AS feature, count(*) FILTER (p_size = 2) AS owners FROM part GROUP BY 1)
        SELECT feature, owners FROM c WHERE owners <> 1"""
)
def source_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that the contract, the smallest parts, does not own exactly once with an allowed flag."""
    part = table(spark, sf_dir, "part")
    flag = F.when(F.col("p_size") == 1, "BLOCK").otherwise("ALLOW")
    contract = part.filter("p_size <= 2").select(F.col("p_brand").alias("feature"), flag.alias("flag"))
    return P.ownership_violations(part.select(F.col("p_brand").alias("feature")).distinct(), contract)
