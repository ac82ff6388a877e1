"""Cleaning and candidate selection over entries with dirty text made from the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.functions import clean as C
from rankfield.operators import candidates as K
from rankfield.plans.analogue import ENTRIES_SQL, entries
from rankfield.plans.registry import query


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with text columns as collectors deliver them."""
    q = F.col("rating") / 3
    n = (q * 12).cast("int")
    return entries(spark, sf_dir).select(
        "race_id",
        "pos",
        "rating",
        "flag",
        "line_status",
        F.when(F.col("entry_no") != 7, F.col("entry_no")).alias("entry_no"),
        F.when(q % 5 == 0, F.lit("-")).when(q % 7 == 0, F.lit("bad")).when(q % 3 == 0, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("("), F.when(q % 2 == 0, "+").otherwise("-"), q.cast("int").cast("string"), F.lit(")"))).alias("weight_text"),
        F.when(q % 11 == 0, F.lit("0")).when(q % 13 == 0, F.lit("abc")).when(q % 17 == 0, F.lit(" ")).otherwise((q * 8).cast("int").cast("string")).alias("odds_text"),
        (q.cast("int") + 30).cast("string").alias("burden_text"),
        F.when(q % 4 == 0, "male").when(q % 4 == 1, "F").when(q % 4 == 2, " 거세 ").otherwise("x").alias("sex_text"),
        F.concat(F.lit(" "), F.col("horse_id").cast("string"), F.lit(".0")).alias("id_text"),
        F.concat((q.cast("int") * 53).cast("string"), F.lit("")).alias("time_text"),
        F.concat(q.cast("int").cast("string"), F.when(q % 2 == 0, "%").otherwise("")).alias("metric_text"),
    )


DIRTY_SQL = (
    ENTRIES_SQL
    + """,
    q_v AS (SELECT *, rating / 3 AS q FROM entries_v),
    dirty_v AS (
        SELECT race_id, pos, rating, flag, CASE WHEN entry_no <> 7 THEN entry_no END AS entry_no,
            CASE WHEN q % 5 = 0 THEN '-' WHEN q % 7 = 0 THEN 'bad' WHEN q % 3 = 0 THEN (q * 12)::INT::VARCHAR
                ELSE (q * 12)::INT::VARCHAR || '(' || CASE WHEN q % 2 = 0 THEN '+' ELSE '-' END || q::INT::VARCHAR || ')' END AS weight_text,
            CASE WHEN q % 11 = 0 THEN '0' WHEN q % 13 = 0 THEN 'abc' WHEN q % 17 = 0 THEN ' ' ELSE (q * 8)::INT::VARCHAR END AS odds_text,
            (q::INT + 30)::VARCHAR AS burden_text,
            CASE WHEN q % 4 = 0 THEN 'male' WHEN q % 4 = 1 THEN 'F' WHEN q % 4 = 2 THEN ' 거세 ' ELSE 'x' END AS sex_text,
            ' ' || horse_id::VARCHAR || '.0' AS id_text, (q::INT * 53)::VARCHAR AS time_text,
            q::INT::VARCHAR || CASE WHEN q % 2 = 0 THEN '%' ELSE '' END AS metric_text FROM q_v)"""
)


@query(
    "WITH "
    + DIRTY_SQL
    + r""", p AS (SELECT *, try_cast(nullif(trim(odds_text), '') AS DOUBLE) AS o, nullif(regexp_extract(weight_text, '\(([+-]?\d+)\)', 1), '') AS d,
            CASE WHEN length(time_text) = 3 THEN '0' || time_text ELSE time_text END AS t FROM dirty_v)
        SELECT race_id, pos, regexp_replace(trim(id_text), '\.0$', '') AS identifier, try_cast(nullif(regexp_extract(weight_text, '(\d+)', 1), '') AS INT) AS weight,
            CASE WHEN d::INT BETWEEN -40 AND 40 THEN d::DOUBLE END AS delta, CASE WHEN o > 0 AND o <= 300 THEN o END AS odds,
            CASE WHEN o > 0 AND o <= 300 THEN '' WHEN trim(odds_text) <> '' AND o IS NULL THEN 'market_signal_missing,odds_parse_failed,popularity_unusable'
                WHEN o > 300 THEN 'market_signal_missing,popularity_unusable,win_odds_outlier' ELSE 'market_signal_missing,popularity_unusable' END AS flags,
            CASE lower(trim(sex_text)) WHEN 'male' THEN '수' WHEN 'f' THEN '암' WHEN '거세' THEN '거' ELSE '기타' END AS sex,
            CASE WHEN length(t) = 4 AND t[1:2]::INT <= 23 AND t[3:4]::INT <= 59 THEN t END AS start_time,
            CASE lower(trim(sex_text)) WHEN 'male' THEN 0.0 WHEN 'f' THEN 1.0 WHEN '거세' THEN 2.0 END::DOUBLE AS sex_code FROM p"""
)
def clean_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, weights, deltas, odds with flags, sex buckets and start times from text."""
    bucket = C.sex_bucket(F.col("sex_text"))
    return dirty(spark, sf_dir).select(
        "race_id",
        "pos",
        C.identifier(F.col("id_text")).alias("identifier"),
        C.first_digits(F.col("weight_text")).alias("weight"),
        C.bounded_delta(F.col("weight_text")).alias("delta"),
        C.market_odds(F.col("odds_text"), C.WIN_ODDS_MAX).alias("odds"),
        F.array_join(C.market_flags(F.col("odds_text"), "win_odds", C.WIN_ODDS_MAX), ",").alias("flags"),
        bucket.alias("sex"),
        C.start_time(F.col("time_text")).alias("start_time"),
        C.coded(bucket, C.SEX_CODES).alias("sex_code"),
    )


@query(
    "WITH "
    + DIRTY_SQL
    + r""", f AS (SELECT weight_text AS w, unnest(CASE WHEN weight_text = '-' THEN ['weight_missing', 'weight_delta_missing'] WHEN weight_text = 'bad' THEN ['weight_parse_failed', 'weight_delta_parse_failed']
            ELSE list_filter([CASE WHEN regexp_extract(weight_text, '^(\d+)', 1)::INT NOT BETWEEN 200 AND 650 THEN 'weight_outlier' END,
                CASE WHEN NOT contains(weight_text, '(') THEN 'weight_delta_missing' WHEN regexp_extract(weight_text, '\(([+-]?\d+)\)', 1)::INT NOT BETWEEN -40 AND 40 THEN 'weight_delta_outlier' END], lambda x: x IS NOT NULL) END) AS flag FROM dirty_v)
        SELECT flag, count(*) AS n FROM f GROUP BY 1"""
)
def weight_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of body weight flags."""
    return dirty(spark, sf_dir).select(F.explode(K.weight_flags(F.col("weight_text"))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + DIRTY_SQL
    + """, m AS (SELECT metric_text, metric_text LIKE '%\\%' ESCAPE '\\' AS pct, replace(metric_text, '%', '')::DOUBLE AS v FROM dirty_v),
        s AS (SELECT *, CASE WHEN pct OR v > 1 + 1e-9 THEN v / 100 ELSE v END AS u FROM m)
        SELECT CASE WHEN pct THEN 'percent_string' WHEN v > 1 + 1e-9 THEN 'percent_numeric' ELSE 'unit_interval' END AS scale, count(*) AS n, round(avg(round(u, 6)), 6) AS normalized,
            round(avg(round(1 - round(u, 6), 6)), 6) AS comparable FROM s GROUP BY 1"""
)
def metric_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics brought to the unit interval, by the scale that was applied."""
    m = dirty(spark, sf_dir).select(C.metric_value(F.col("metric_text"), maximize=False).alias("m")).select("m.*")
    return m.groupBy("scale").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("normalized"), 6).alias("normalized"), F.round(F.avg("comparable"), 6).alias("comparable"))


STATUS_SQL = """,
    cancelled_v AS (SELECT race_id, pos AS cpos, entry_no AS cno, CASE WHEN line_status = 'O' THEN 'withdrawn' ELSE 'cancelled' END AS official FROM entries_v WHERE flag = 'R' AND discount >= 0.09),
    status_v AS (
        SELECT d.*, CASE WHEN d.entry_no IS NULL THEN 'invalid_entry_missing_chul_no' WHEN c.official IS NOT NULL THEN c.official
            WHEN burden_text::INT < 40 OR burden_text::INT > 65 THEN 'wg_budam_outlier' WHEN odds_text = '0' THEN 'zero_market_signal' END AS reason
        FROM dirty_v d LEFT JOIN cancelled_v c ON d.race_id = c.race_id AND d.entry_no = c.cno),
    short_v AS (SELECT *, 3 - count(*) FILTER (reason IS NULL) OVER (PARTITION BY race_id) AS short,
        CASE reason WHEN 'zero_market_signal' THEN 10 WHEN 'wg_budam_outlier' THEN 20 END AS priority FROM status_v),
    back_v AS (SELECT *, priority IS NOT NULL AND row_number() OVER (PARTITION BY race_id ORDER BY priority NULLS LAST, pos) <= short AS back FROM short_v),
    spare_v AS (SELECT *, short - count(*) FILTER (back) OVER (PARTITION BY race_id) AS still,
        reason IS NOT NULL AND NOT back AND reason NOT IN ('cancelled', 'withdrawn', 'excluded') AND coalesce(entry_no > 0, false) AS spare FROM back_v),
    staged_v AS (SELECT *, CASE WHEN reason IS NULL THEN 'eligible' WHEN back THEN 'reincluded'
        WHEN spare AND row_number() OVER (PARTITION BY race_id ORDER BY spare DESC, pos) <= still THEN 'fallback' END AS stage FROM spare_v)"""


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty entries with exclusion reason and selection stage."""
    rows = dirty(spark, sf_dir)
    official = F.when(F.col("line_status") == "O", K.cancellation_status(F.lit("기권"))).otherwise(K.cancellation_status(F.lit("취소")))
    cancelled = entries(spark, sf_dir).filter((F.col("flag") == "R") & (F.col("discount") >= 0.09)).select("race_id", "pos", "entry_no", official.alias("official"))
    rows = K.with_cancellations(rows, cancelled, "race_id", ["entry_no"], "official")
    reason = K.exclusion_reason(F.col("entry_no"), F.col("official"), F.col("burden_text"), F.col("odds_text"), F.lit(None))
    return K.select_candidates(rows.withColumn("reason", reason), "race_id", "pos", "reason", F.col("entry_no") > 0)


@query("WITH " + DIRTY_SQL + STATUS_SQL + " SELECT race_id, pos, entry_no, reason, stage FROM staged_v")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, re-inclusion and fallback of every entry."""
    return selected(spark, sf_dir).select("race_id", "pos", "entry_no", "reason", "stage")


@query(
    "WITH "
    + DIRTY_SQL
    + STATUS_SQL
    + """, r AS (SELECT race_id, count(*) FILTER (reason IS NULL) AS eligible, count(*) AS total, count(*) FILTER (stage IS NOT NULL) AS chosen,
            list_sort(list_distinct(list(CASE WHEN reason IN ('cancelled', 'withdrawn') THEN 'official_status' WHEN reason = 'zero_market_signal' THEN 'market_signal' WHEN reason IS NOT NULL THEN 'data_quality' END)
                FILTER (reason IS NOT NULL))) AS classes FROM staged_v GROUP BY 1)
        SELECT CASE WHEN eligible >= 3 THEN 'sufficient_candidates' WHEN total < 3 THEN 'raw_field_too_small' WHEN len(classes) > 1 THEN 'mixed_reasons_reduced_below_minimum'
            ELSE classes[1] || '_reduced_below_minimum' END AS shortage, count(*) AS races, sum(chosen)::BIGINT AS chosen FROM r GROUP BY 1"""
)
def shortage_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by why they are short of candidates."""
    rows = selected(spark, sf_dir).groupBy("race_id").agg(
        F.count(F.when(F.col("reason").isNull(), 1)).alias("eligible"),
        F.count(F.lit(1)).alias("total"),
        F.count("stage").alias("chosen"),
        F.collect_set(K.reason_class(F.col("reason"))).alias("classes"),
    )
    label = K.shortage_class(F.col("eligible"), F.col("total"), F.col("classes"))
    return rows.groupBy(label.alias("shortage")).agg(F.count(F.lit(1)).alias("races"), F.sum("chosen").alias("chosen"))


@query("WITH " + DIRTY_SQL + STATUS_SQL + " SELECT coalesce(reason, 'normal') AS rule, coalesce(stage, 'left out') AS stage, count(*) AS n FROM staged_v GROUP BY ALL")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by exclusion rule and selection stage."""
    rows = selected(spark, sf_dir)
    return rows.groupBy(F.coalesce("reason", F.lit("normal")).alias("rule"), F.coalesce("stage", F.lit("left out")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
