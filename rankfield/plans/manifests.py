"""Audits of manifests, traces, documents, packs and the release gate, over records made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.operators import manifests as M
from rankfield.plans.analogue import ENTRIES_SQL, EVENTS_SQL, entries, events
from rankfield.plans.registry import query

# Records made from the keys of events, in SQL that both engines read alike.
RECORD = {
    "race_id": "CASE WHEN race_id % 97 = 0 THEN '' ELSE CAST(race_id AS VARCHAR(20)) END",
    "source_filter_basis": "CASE race_id % 7 WHEN 0 THEN 'updated_at' WHEN 1 THEN NULL ELSE 'entry_finalized_at' END",
    "timestamp_source": "CASE race_id % 5 WHEN 0 THEN 'source_revision' WHEN 1 THEN 'snapshot_collected_at' WHEN 2 THEN 'derived_from_schedule' WHEN 3 THEN 'other' END",
    "timestamp_confidence": "CASE race_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
    "replay_status": "CASE race_id % 4 WHEN 0 THEN 'partial_snapshot' WHEN 1 THEN 'strict' WHEN 2 THEN 'missing_timestamp' END",
    "include_in_strict_dataset": "CASE WHEN race_id % 13 <> 0 THEN race_id % 2 = 0 END",
    "hard_required_sources_present": "race_id % 3 <> 0",
    "late_reissue_after_cutoff": "CASE WHEN race_id % 17 <> 0 THEN false END",
    "cutoff_unbounded": "race_id % 6 = 0",
    "entry_finalized_at": "CASE WHEN race_id % 8 <> 0 THEN race_id % 20 END",
    "operational_cutoff_at": "CASE WHEN race_id % 9 <> 0 THEN race_id % 15 END",
    "scheduled_start_at": "CASE WHEN race_id % 10 <> 0 THEN race_id % 25 END",
    "snapshot_ready_at": "CASE WHEN race_id % 11 <> 0 THEN race_id % 20 + race_id % 2 END",
}
_RECORDS = "WITH " + EVENTS_SQL + f", m AS (SELECT {', '.join(f'{e} AS {c}' for c, e in RECORD.items())} FROM events_v)"
_LOGS = ", ".join(f"CASE WHEN coalesce(trim({c}::VARCHAR), '') = '' THEN 'missing_log_field' END" for c in M.LOG_FIELDS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(*[F.expr(e).alias(c) for c, e in RECORD.items()])


@query(
    _RECORDS
    + f""", c AS (SELECT race_id, unnest([{_LOGS},
            CASE WHEN coalesce(source_filter_basis, '') <> 'entry_finalized_at' THEN 'unexpected_source_filter_basis' END,
            CASE WHEN include_in_strict_dataset AND NOT hard_required_sources_present THEN 'strict_without_required_sources' END,
            CASE WHEN include_in_strict_dataset AND entry_finalized_at IS NULL THEN 'missing_entry_finalized_at' END,
            CASE WHEN NOT cutoff_unbounded AND operational_cutoff_at IS NULL THEN 'missing_operational_cutoff_at' END,
            CASE WHEN NOT cutoff_unbounded AND scheduled_start_at IS NULL THEN 'missing_scheduled_start_at' END,
            CASE WHEN include_in_strict_dataset AND entry_finalized_at > operational_cutoff_at THEN 'post_cutoff_snapshot' END,
            CASE WHEN include_in_strict_dataset AND replay_status IN ('partial_snapshot', 'late_snapshot_unusable', 'missing_timestamp') THEN 'excluded_status_marked_included' END,
            CASE WHEN CASE timestamp_source WHEN 'source_revision' THEN 'high' WHEN 'snapshot_collected_at' THEN 'medium' WHEN 'derived_from_schedule' THEN 'low' END <> timestamp_confidence THEN 'timestamp_confidence_mismatch' END,
            CASE WHEN timestamp_source = 'snapshot_collected_at' AND snapshot_ready_at IS NULL THEN 'missing_snapshot_ready_at' END,
            CASE WHEN timestamp_source = 'snapshot_collected_at' AND entry_finalized_at <> snapshot_ready_at THEN 'entry_snapshot_timestamp_mismatch' END]) AS code FROM m)
        SELECT code, count(*) AS n, count(DISTINCT race_id) AS races, max(CASE WHEN race_id = '' THEN 'unknown' ELSE race_id END) AS last FROM c WHERE code IS NOT NULL GROUP BY code"""
)
def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven codes of broken rules over a manifest's timing records, counted."""
    found = M.manifest_violations(records(spark, sf_dir))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("race_id").alias("races"), F.max("race_id").alias("last"))


@query(_RECORDS + " SELECT coalesce(replay_status, 'unknown') AS replay_status, count(*) AS races, count(*) FILTER (include_in_strict_dataset) AS strict FROM m GROUP BY 1")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and strict events of a manifest by status."""
    return M.manifest_summary(records(spark, sf_dir))


@query(
    "WITH "
    + EVENTS_SQL
    + """, t AS (SELECT race_id, race_id % 5 <> 0 AS validated, race_id % 7 <> 0 AS traced, race_id % 3 <> 0 AS met, race_id % 4 AS n, CASE WHEN race_id % 6 = 0 THEN NULL ELSE race_id % 4 END AS traced_n, race_id % 2 = 0 AS fields FROM events_v),
        c AS (SELECT race_id, unnest(CASE WHEN NOT validated THEN ['missing_candidate_validation'] WHEN NOT traced THEN ['missing_candidate_trace'] ELSE
            [CASE WHEN NOT met THEN 'minimum_candidate_not_met' END, CASE WHEN traced_n IS NULL THEN 'candidate_count_trace_mismatch' END, CASE WHEN NOT fields THEN 'missing_candidate_trace_field' END, CASE WHEN NOT fields THEN 'missing_candidate_trace_field' END] END) AS code FROM t)
        SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY 1"""
)
def trace_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of candidate traces, counted by code."""
    i = F.col("race_id")
    fields = F.when(i % 2 == 0, F.array(*[F.lit(c) for c in M.TRACE_FIELDS])).otherwise(F.array(F.lit("final_candidates"), F.lit("final_candidate_chul_nos")))
    traces = events(spark, sf_dir).select(
        "race_id",
        F.when(i % 5 != 0, F.struct((i % 3 != 0).alias("minimum_met"), (i % 4).alias("count"))).alias("validation"),
        F.when(i % 7 != 0, F.struct(F.when(i % 6 != 0, i % 4).alias("count"), fields.alias("fields"))).alias("trace"),
    )
    return M.trace_violations(traces).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, p AS (SELECT race_id, meet, race_id % 50 <> 0 AS fresh, CASE WHEN race_id % 60 = 0 THEN 2 ELSE 0 END AS odds, race_id % 4 <> 0 AS present, count(*) AS horses, count(*) FILTER (horse_id % 3 = 0) AS nulls FROM entries_v GROUP BY ALL)
        SELECT meet, count(*) AS race_count, count(*) FILTER (NOT fresh) AS failed_count, sum(odds)::BIGINT AS violating_paths, count(*) FILTER (present) AS source_present, count(*) FILTER (NOT present) AS source_missing,
            sum(horses)::BIGINT AS horses, sum(nulls)::BIGINT AS null_flags, round(count(*) FILTER (fresh) / count(*), 9) AS pass_rate, round(sum(nulls) / sum(horses), 9) AS null_rate, bool_and(fresh) AND sum(odds) = 0 AS passed FROM p GROUP BY meet"""
)
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safety gate over the payloads of each meet."""
    i = F.col("race_id")
    grouped = entries(spark, sf_dir).groupBy("race_id", "meet").agg(F.count(F.lit(1)).alias("horses"), F.count(F.when(F.col("horse_id") % 3 == 0, 1)).alias("horses_without_flag"))
    payloads = grouped.select("*", (i % 50 != 0).alias("fresh"), F.when(i % 60 == 0, 2).otherwise(0).alias("odds_paths"), (i % 4 != 0).alias("source_present"))
    gates = [M.release_gate(payloads.filter(F.col("meet") == m)).withColumn("meet", F.lit(m)) for m in (1, 2, 3)]
    whole = gates[0].unionByName(gates[1]).unionByName(gates[2])
    return whole.select("meet", "race_count", "failed_count", "violating_paths", "source_present", "source_missing", "horses", "null_flags", F.round("pass_rate", 9).alias("pass_rate"), F.round("null_rate", 9).alias("null_rate"), "passed")


@query(
    "WITH "
    + ENTRIES_SQL
    + """, h AS (SELECT race_id, row_number() OVER (PARTITION BY race_id ORDER BY entry_no) AS place, CASE WHEN horse_id % 20 = 0 THEN 1 ELSE entry_no END AS no, horse_id, CASE horse_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN 'heavy' ELSE '55' END AS w FROM entries_v),
        e AS (SELECT race_id, unnest([
            CASE WHEN horse_id % 30 = 7 THEN '.hr_name is required' END, CASE WHEN w IS NULL THEN '.wg_budam is required' END, CASE WHEN w IS NULL OR w = 'heavy' THEN '.wg_budam must be numeric' END, CASE WHEN w = '0' THEN '.wg_budam must be greater than zero' END,
            CASE WHEN horse_id % 9 = 0 THEN '.training must be an object' END, CASE WHEN EXISTS (SELECT 1 FROM h b WHERE b.race_id = h.race_id AND b.place < h.place AND b.no = h.no) THEN '.chul_no duplicates another horse' END]) AS issue FROM h),
        r AS (SELECT race_id, unnest([
            CASE WHEN race_id % 6 = 0 THEN 'schema_version must be prerace-source-v1' END, CASE WHEN race_id % 8 = 0 THEN 'date must match race_date' END, CASE WHEN race_id % 12 = 0 THEN 'race_no must be a positive integer' END,
            CASE WHEN race_id % 9 = 0 THEN 'collected_at must be an ISO-8601 datetime' END, CASE WHEN race_id % 10 = 0 AND race_id % 5 = 0 THEN 'status must be partial_failure when failed_horses is not empty' END,
            CASE WHEN race_id % 7 = 0 THEN 'race_info must include response.body.items.item' END, CASE WHEN race_id % 7 <> 0 AND race_id % 4 = 0 THEN 'race_info meet does not match top-level meet' END,
            CASE WHEN race_id % 11 = 0 THEN 'track must be an object' END, CASE WHEN race_id % 11 <> 0 AND race_id % 3 = 0 THEN 'track.weather is required' END]) AS issue FROM (SELECT DISTINCT race_id FROM h))
        SELECT issue, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM r) WHERE issue IS NOT NULL GROUP BY 1"""
)
def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of event documents and their entries, counted by what they say."""
    h, i = F.col("horse_id"), F.col("race_id")
    weight = F.when(h % 10 == 0, None).when(h % 10 == 1, "0").when(h % 10 == 2, "heavy").otherwise("55")
    made = {c: F.lit("x") for c in M.ENTRY_FIELDS} | {"chul_no": F.when(h % 20 == 0, 1).otherwise(F.col("entry_no")), "wg_budam": weight, "hr_name": F.when(h % 30 != 7, "H")}
    blocks = F.when(h % 9 == 0, F.array(*[F.lit(c) for c in M.DETAIL_FIELDS[:5]])).otherwise(F.array(*[F.lit(c) for c in M.DETAIL_FIELDS]))
    listed = entries(spark, sf_dir).groupBy("race_id", "meet").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", F.struct(*[c.alias(n) for n, c in made.items()], blocks.alias("blocks")).alias("h")))), lambda x: x["h"]).alias("horses"))
    number = F.when(i % 12 != 0, i % 12)
    documents = listed.select(
        "race_id",
        "horses",
        "meet",
        F.when(i % 6 == 0, "v0").otherwise(M.SCHEMA_VERSION).alias("schema_version"),
        F.lit("20240101").alias("race_date"),
        F.when(i % 8 == 0, "20240102").otherwise("20240101").alias("date"),
        number.alias("race_no"),
        number.alias("race_number"),
        F.when(i % 9 == 0, "yesterday").otherwise("2024-01-01T10:00:00").alias("collected_at"),
        F.when((i % 5 == 0) & (i % 10 != 0), "partial_failure").otherwise("success").alias("status"),
        F.when(i % 5 == 0, F.array(F.lit("H1"))).otherwise(F.array().cast("array<string>")).alias("failed"),
        F.when(i % 7 != 0, F.struct(F.lit("20240101").alias("race_date"), number.alias("race_no"), F.when(i % 4 == 0, 9).otherwise(F.col("meet")).alias("meet"))).alias("card"),
        F.struct(*[F.lit("x").alias(c) for c in M.PLAN_FIELDS]).alias("race_plan"),
        F.when(i % 11 != 0, F.struct(F.when(i % 3 == 0, "").otherwise("맑음").alias("weather"), F.lit("건조").alias("track"), F.lit("3").alias("water_percent"))).alias("track"),
    )
    issues = M.document_issues(documents).withColumn("issue", F.regexp_replace("issue", r"^horses\[\d+\]", ""))
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, m AS (SELECT race_id, unnest([CASE WHEN horse_id % 11 = 0 THEN 'Missing hr_no' END, CASE WHEN rider_id = 3 THEN 'Missing hr_name' END, CASE WHEN horse_id % 7 IN (0, 1) THEN 'Missing win_odds' END,
            CASE WHEN horse_id % 7 = 2 THEN 'Invalid win_odds format' WHEN horse_id % 7 IN (1, 3) THEN 'Invalid win_odds' END]) AS message FROM entries_v)
        SELECT message, count(*) AS n FROM m WHERE message IS NOT NULL GROUP BY 1"""
)
def entry_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages about collected entries, counted."""
    h = F.col("horse_id")
    odds = F.when(h % 7 == 0, None).when(h % 7 == 1, "0").when(h % 7 == 2, "abc").when(h % 7 == 3, "-1.5").otherwise("3.4")
    said = M.entry_messages(F.when(h % 11 != 0, h), F.when(F.col("rider_id") != 3, "H"), odds)
    return entries(spark, sf_dir).select(F.explode(said).alias("message")).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + ENTRIES_SQL
    + """, v AS (SELECT race_id, meet, race_id % 6 <> 0 AND bool_and(horse_id % 40 <> 0) AND min(CASE WHEN horse_id % 35 = 1 THEN -1 ELSE 1 END) > 0 AS ok FROM entries_v GROUP BY 1, 2),
        p AS (SELECT race_id, count(*) FILTER (entry_no <= 3) = 3 AND race_id % 5 <> 0 AS ok FROM entries_v GROUP BY 1)
        SELECT meet, count(*) FILTER (v.ok) AS valid_events, count(*) FILTER (p.ok) AS valid_predictions FROM v JOIN p USING (race_id) GROUP BY 1"""
)
def structure_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and predictions that pass the structural checks, by meet."""
    h, i = F.col("horse_id"), F.col("race_id")
    entry = F.struct(F.when(h % 40 != 0, F.col("entry_no")).alias("horse_no"), F.when(h % 35 == 1, -1.0).otherwise(2.0).alias("win_odds"))
    listed = entries(spark, sf_dir).groupBy("race_id", "meet").agg(F.collect_list(entry).alias("entries"), F.collect_list(F.when(F.col("entry_no") <= 3, F.col("entry_no"))).alias("p"))
    predicted = F.when(i % 5 == 0, F.concat(F.slice("p", 1, 2), F.slice("p", 1, 1))).otherwise(F.col("p"))
    checked = listed.select("meet", M.valid_event(F.when(i % 6 != 0, F.lit("20240101")), F.lit(1), F.col("entries")).alias("e"), M.valid_prediction(predicted).alias("p"))
    return checked.groupBy("meet").agg(F.count(F.when(F.col("e"), 1)).alias("valid_events"), F.count(F.when(F.col("p"), 1)).alias("valid_predictions"))


@query(
    "WITH "
    + EVENTS_SQL
    + """, d AS (SELECT race_id, race_id % 20 AS stamp, CASE WHEN race_id % 9 = 0 THEN NULL ELSE race_id % 20 END AS looked FROM events_v WHERE race_id % 10 <> 0 UNION ALL SELECT race_id, race_id % 20, race_id % 20 FROM events_v WHERE race_id % 50 = 1),
        m AS (SELECT race_id, CASE WHEN race_id % 7 = 0 THEN 99 ELSE race_id % 20 END AS stamp FROM events_v WHERE race_id % 11 <> 0), a AS (SELECT race_id FROM events_v WHERE race_id % 6 <> 0),
        i AS (SELECT race_id FROM d UNION SELECT race_id FROM m),
        c AS (SELECT race_id, unnest([
            CASE WHEN (SELECT count(*) FROM d WHERE d.race_id = i.race_id) > 1 THEN 'duplicate_race' END,
            CASE WHEN race_id IN (SELECT race_id FROM d) AND race_id NOT IN (SELECT race_id FROM m) THEN 'missing_from_manifest' END,
            CASE WHEN race_id NOT IN (SELECT race_id FROM d) THEN 'missing_from_dataset' END,
            CASE WHEN race_id IN (SELECT race_id FROM d) AND race_id NOT IN (SELECT race_id FROM a) THEN 'missing_answer' END,
            CASE WHEN race_id IN (SELECT race_id FROM d) AND race_id IN (SELECT race_id FROM m WHERE stamp = 99) THEN 'timing_mismatch' END,
            CASE WHEN race_id IN (SELECT race_id FROM d WHERE looked IS NULL) THEN 'lookup_mismatch' END]) AS code FROM i)
        SELECT code, count(*) AS n, min(race_id) AS first FROM c WHERE code IS NOT NULL GROUP BY 1"""
)
def pack_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a dataset, its answers and its manifest disagree, by code."""
    e, i = events(spark, sf_dir), F.col("race_id")
    row = [i, (i % 20).alias("entry_finalized_at")]
    dataset = e.filter(i % 10 != 0).select(*row, F.when(i % 9 != 0, i % 20).alias("entry_snapshot_at")).union(e.filter(i % 50 == 1).select(*row, (i % 20).alias("entry_snapshot_at")))
    manifest = e.filter(i % 11 != 0).select(i, F.when(i % 7 == 0, 99).otherwise(i % 20).alias("entry_finalized_at"))
    found = M.pack_violations(dataset, e.filter(i % 6 != 0).select(i), manifest)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("race_id").alias("first"))


@query(
    "WITH "
    + EVENTS_SQL
    + """, b AS (SELECT meet, count(*) AS n, count(*) FILTER (race_id % 20 = 0) AS unmet FROM events_v GROUP BY 1), i AS (SELECT meet, unnest([CASE WHEN n < 10000000 THEN n || ' of 10000000 races' END, CASE WHEN unmet > 0 THEN unmet || ' races below the candidate minimum' END]) AS issue FROM b WHERE meet = 2)
        SELECT * FROM i WHERE issue IS NOT NULL"""
)
def bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a bundle has its least number of events, all with candidates enough."""
    bundle = events(spark, sf_dir).filter("meet = 2").select("race_id", (F.col("race_id") % 20 != 0).alias("minimum_met"))
    return M.bundle_issues(bundle, 10_000_000).select(F.lit(2).alias("meet"), "issue")


@query(
    "WITH "
    + EVENTS_SQL
    + """, r AS (SELECT race_id, race_date, meet, row_number() OVER (PARTITION BY race_date ORDER BY meet, race_id)::INT AS place, count(*) OVER (PARTITION BY race_date) AS n FROM events_v)
        SELECT race_id, place, n, substr(sha256('{"meet":' || meet || ',"race_id":' || race_id || '}'), 1, 16) AS snapshot_id FROM r"""
)
def snapshot_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by date in order, with a deterministic snapshot id."""
    placed = M.events_of_date(events(spark, sf_dir), "meet", "race_id")
    ids = M.snapshot_ids(events(spark, sf_dir).select("race_id", "meet"), ["race_id", "meet"])
    return placed.join(ids.select("race_id", "snapshot_id"), "race_id").select("race_id", "place", "n", "snapshot_id")


@query(_RECORDS + " SELECT max(entry_finalized_at) AS entry_finalized_at, greatest(max(entry_finalized_at), max(snapshot_ready_at)) AS data_at, greatest(max(entry_finalized_at), max(snapshot_ready_at), 5) AS created_at FROM m")
def snapshot_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times that a snapshot's metadata takes from its records."""
    return M.later_of(records(spark, sf_dir).withColumn("updated_at", F.col("snapshot_ready_at")), F.lit(5).cast("long"))
