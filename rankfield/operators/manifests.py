"""Audits of snapshot manifests, candidate traces, event documents, dataset packs and the release gate.

Each audit is an array of conditional codes per row, unnested once; counts are a group of those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions import clean

# Fixed values.
LOG_FIELDS = ["race_id", "source_filter_basis", "timestamp_source", "timestamp_confidence", "replay_status", "include_in_strict_dataset", "hard_required_sources_present", "late_reissue_after_cutoff", "cutoff_unbounded"]
CONFIDENCE = {"source_revision": "high", "snapshot_collected_at": "medium", "derived_from_schedule": "low", "fallback_collected_only": "low"}
EXCLUDED = ["partial_snapshot", "late_snapshot_unusable", "missing_timestamp"]
FILTER_BASIS = "entry_finalized_at"
TRACE_FIELDS = ["applied_rule_ids", "reintroduced_targets", "final_candidates", "final_candidate_chul_nos"]
SCHEMA_VERSION = "prerace-source-v1"
PLAN_FIELDS, TRACK_FIELDS = ["rank", "budam", "rc_dist", "age_cond"], ["weather", "track", "water_percent"]
ENTRY_FIELDS = ["chul_no", "hr_no", "hr_name", "jk_no", "jk_name", "tr_no", "tr_name", "ow_no", "ow_name", "age", "sex", "name", "rank", "wg_budam"]
DETAIL_FIELDS = ["hrDetail", "jkDetail", "trDetail", "jkStats", "owDetail", "training"]


def _truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(race_id, code) of every broken rule of a manifest's timing records.

    A record has LOG_FIELDS (flags as booleans) and the timestamps entry_finalized_at,
    operational_cutoff_at, scheduled_start_at and snapshot_ready_at, null where unreadable.
    """
    strict, unbounded = _truth(F.col("include_in_strict_dataset")), _truth(F.col("cutoff_unbounded"))
    finalized, cutoff, ready = F.col("entry_finalized_at"), F.col("operational_cutoff_at"), F.col("snapshot_ready_at")
    source, of_snapshot = F.col("timestamp_source"), F.col("timestamp_source") == "snapshot_collected_at"
    rules = [
        *[(clean.text(F.col(c)).isNull(), "missing_log_field") for c in LOG_FIELDS],
        (F.coalesce(F.col("source_filter_basis"), F.lit("")) != FILTER_BASIS, "unexpected_source_filter_basis"),
        (strict & ~_truth(F.col("hard_required_sources_present")), "strict_without_required_sources"),
        (strict & finalized.isNull(), "missing_entry_finalized_at"),
        (~unbounded & cutoff.isNull(), "missing_operational_cutoff_at"),
        (~unbounded & F.col("scheduled_start_at").isNull(), "missing_scheduled_start_at"),
        (strict & (finalized > cutoff), "post_cutoff_snapshot"),
        (strict & F.col("replay_status").isin(EXCLUDED), "excluded_status_marked_included"),
        (clean.coded(source, CONFIDENCE) != F.coalesce(F.col("timestamp_confidence"), F.lit("")), "timestamp_confidence_mismatch"),
        (of_snapshot & ready.isNull(), "missing_snapshot_ready_at"),
        (of_snapshot & (finalized != ready), "entry_snapshot_timestamp_mismatch"),
    ]
    codes = F.array_compact(F.array(*[F.when(_truth(broken), code) for broken, code in rules]))
    return manifest.select(F.coalesce(clean.text(F.col("race_id")), F.lit("unknown")).alias("race_id"), F.explode(codes).alias("code"))


def trace_violations(traces: DataFrame) -> DataFrame:
    """(race_id, code) of candidate traces: blocks ``validation`` (minimum_met, count) and ``trace`` (count, fields present).

    Without a validation, or else without a trace, nothing more is said of an event.
    """
    validation, trace = F.col("validation"), F.col("trace")
    further = F.array(
        F.when(~_truth(validation["minimum_met"]), "minimum_candidate_not_met"),
        F.when(~trace["count"].eqNullSafe(validation["count"]), "candidate_count_trace_mismatch"),
        *[F.when(~_truth(F.array_contains(trace["fields"], c)), "missing_candidate_trace_field") for c in TRACE_FIELDS],
    )
    codes = F.when(validation.isNull(), F.array(F.lit("missing_candidate_validation"))).when(trace.isNull(), F.array(F.lit("missing_candidate_trace"))).otherwise(F.array_compact(further))
    return traces.select("race_id", F.explode(codes).alias("code"))


def release_gate(payloads: DataFrame) -> DataFrame:
    """One row: rates and counts of the gate over payloads (fresh, odds_paths, source_present, horses, horses_without_flag), and whether all passes."""
    count = lambda c: F.count(F.when(c, 1))
    fresh = _truth(F.col("fresh"))
    counted = payloads.agg(
        F.count(F.lit(1)).alias("race_count"),
        count(~fresh).alias("failed_count"),
        F.coalesce(F.sum("odds_paths"), F.lit(0)).alias("violating_paths"),
        count(_truth(F.col("source_present"))).alias("source_present"),
        count(~_truth(F.col("source_present"))).alias("source_missing"),
        F.coalesce(F.sum("horses"), F.lit(0)).alias("horses"),
        F.coalesce(F.sum("horses_without_flag"), F.lit(0)).alias("null_flags"),
    )
    rate = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    return counted.select(
        "*",
        rate(F.col("race_count") - F.col("failed_count"), F.col("race_count")).alias("pass_rate"),
        rate(F.col("null_flags"), F.col("horses")).alias("null_rate"),
        ((F.col("race_count") > 0) & (F.col("failed_count") == 0) & (F.col("violating_paths") == 0)).alias("passed"),
    )


def key_paths(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The (key, path) rows of leaf paths that hold one of the keys on the way."""
    return paths.filter(F.exists(F.split("path", r"\.|\[\]"), lambda part: part.isin(keys)))


def entry_issues(entry: Column, place: Column) -> Column:
    """Messages about one entry of an event document: what is required, and numbers in their ranges."""
    prefix = F.concat(F.lit("horses["), place.cast("string"), F.lit("]"))
    number, weight = clean.whole(entry["chul_no"]), clean.number(entry["wg_budam"])
    say = lambda broken, words: F.when(_truth(broken), F.concat(prefix, F.lit(words)))
    return F.array_compact(
        F.array(
            *[say(F.coalesce(entry[c].cast("string"), F.lit("")) == "", f".{c} is required") for c in ENTRY_FIELDS],
            say(~_truth(number > 0), ".chul_no must be a positive integer"),
            say(weight.isNull(), ".wg_budam must be numeric"),
            say(weight <= 0, ".wg_budam must be greater than zero"),
            *[say(~_truth(F.array_contains(entry["blocks"], c)), f".{c} must be an object") for c in DETAIL_FIELDS],
        )
    )


def document_issues(documents: DataFrame) -> DataFrame:
    """(race_id, issue) of event documents: keys, status, blocks and entries; an entry number may stand once.

    Columns: race_id, schema_version, race_date, date, race_no, race_number, meet, collected_at,
    status, failed (array), card (struct of keys, null without items), race_plan, track, horses (array of structs).
    """
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    card, horses = F.col("card"), F.col("horses")
    differs = lambda own, top: card[own].isNotNull() & ~card[own].eqNullSafe(F.col(top))
    failed = F.size(F.coalesce("failed", F.array().cast("array<string>"))) > 0
    rules = [
        (~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), f"schema_version must be {SCHEMA_VERSION}"),
        (F.col("race_date").isNull(), "race_date is required and must be YYYYMMDD"),
        (~F.col("date").eqNullSafe(F.col("race_date")), "date must match race_date"),
        (~_truth(F.col("race_no") > 0), "race_no must be a positive integer"),
        (~F.col("race_number").eqNullSafe(F.col("race_no")), "race_number must match race_no"),
        (~_truth(F.col("meet") > 0), "meet must be a positive integer"),
        (F.col("collected_at").try_cast("timestamp").isNull(), "collected_at must be an ISO-8601 datetime"),
        (~_truth(F.col("status").isin("success", "partial_failure")), "status must be success or partial_failure"),
        (F.col("failed").isNull(), "failed_horses must be a list"),
        (failed & ~F.col("status").eqNullSafe(F.lit("partial_failure")), "status must be partial_failure when failed_horses is not empty"),
        (F.col("failed").isNotNull() & ~failed & ~F.col("status").eqNullSafe(F.lit("success")), "status must be success when failed_horses is empty"),
        (card.isNull(), "race_info must include response.body.items.item"),
        *[(differs(own, top), f"race_info {own} does not match top-level {top}") for own, top in (("race_date", "race_date"), ("race_no", "race_no"), ("meet", "meet"))],
        *[(F.col(block).isNull(), f"{block} must be an object") for block in ("race_plan", "track")],
        *[(F.col(block).isNotNull() & blank(F.col(block)[c]), f"{block}.{c} is required") for block, fields in (("race_plan", PLAN_FIELDS), ("track", TRACK_FIELDS)) for c in fields],
        (F.coalesce(F.size("horses"), F.lit(0)) <= 0, "horses must be a non-empty list"),
    ]
    own = F.array_compact(F.array(*[F.when(_truth(broken), message) for broken, message in rules]))
    of_entries = F.coalesce(F.flatten(F.transform(horses, lambda h, i: entry_issues(h, i + 1))), F.array().cast("array<string>"))
    numbers = F.transform(horses, lambda h: clean.whole(h["chul_no"]))
    repeats = F.filter(
        F.transform(numbers, lambda n, i: F.when(_truth(n > 0) & F.array_contains(F.slice(numbers, F.lit(1), i), n), F.concat(F.lit("horses["), (i + 1).cast("string"), F.lit("].chul_no duplicates another horse")))), lambda x: x.isNotNull()
    )
    every = F.concat(own, of_entries, F.coalesce(repeats, F.array().cast("array<string>")))
    return documents.select("race_id", F.explode(every).alias("issue"))


def entry_messages(hr_no: Column, hr_name: Column, win_odds: Column) -> Column:
    """What a collected entry lacks: missing fields (a zero counts as missing), odds not above 0 or not a number."""
    value = clean.number(win_odds)
    lacks = lambda c, name: F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0"), F.lit(f"Missing {name}"))
    odds = F.when(win_odds.isNotNull() & value.isNull(), "Invalid win_odds format").when(value <= 0, "Invalid win_odds")
    return F.array_compact(F.array(lacks(hr_no, "hr_no"), lacks(hr_name, "hr_name"), lacks(win_odds, "win_odds"), odds))


def valid_event(race_date: Column, race_no: Column, entries: Column) -> Column:
    """Whether an event has its keys and entries, all with a number and none with odds below 0."""
    return race_date.isNotNull() & race_no.isNotNull() & _truth(F.size(entries) > 0) & _truth(F.forall(entries, lambda e: e["horse_no"].isNotNull() & (F.coalesce(e["win_odds"], F.lit(0.0)) >= 0)))


def valid_prediction(predicted: Column) -> Column:
    """Whether a prediction is three different numbers."""
    return _truth((F.size(predicted) == 3) & (F.size(F.array_distinct(predicted)) == 3))


def pack_violations(dataset: DataFrame, answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """(race_id, code): where a dataset, its answers and its manifest disagree.

    Dataset rows have race_id, entry_finalized_at and entry_snapshot_at, manifest rows race_id and
    entry_finalized_at. Copies of an id, ids without an answer, ids on one side only, and
    timestamps that differ are told; every comparison is an equi-join on the id.
    """
    count = lambda rows, name: rows.groupBy("race_id").agg(F.count(F.lit(1)).alias(name))
    stamps = dataset.groupBy("race_id").agg(F.count(F.lit(1)).alias("in_dataset"), F.min("entry_finalized_at").alias("at"), F.max(~F.col("entry_finalized_at").eqNullSafe(F.col("entry_snapshot_at"))).alias("off"))
    known = manifest.groupBy("race_id").agg(F.count(F.lit(1)).alias("in_manifest"), F.min("entry_finalized_at").alias("listed_at"))
    joined = stamps.join(known, "race_id", "full").join(count(answers, "answered"), "race_id", "left")
    has, listed = F.col("in_dataset").isNotNull(), F.col("in_manifest").isNotNull()
    codes = F.array(
        F.when(F.col("in_dataset") > 1, "duplicate_race"),
        F.when(F.col("in_manifest") > 1, "duplicate_manifest_race"),
        F.when(has & ~listed, "missing_from_manifest"),
        F.when(~has & listed, "missing_from_dataset"),
        F.when(has & F.col("answered").isNull(), "missing_answer"),
        F.when(has & listed & ~F.col("at").eqNullSafe(F.col("listed_at")), "timing_mismatch"),
        F.when(has & F.col("off"), "lookup_mismatch"),
    )
    return joined.select("race_id", F.explode(F.array_compact(codes)).alias("code"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """(replay_status, races, strict): the status histogram of a manifest, with its strict events."""
    status = F.coalesce("replay_status", F.lit("unknown")).alias("replay_status")
    return manifest.groupBy(status).agg(F.count(F.lit(1)).alias("races"), F.count(F.when(F.col("include_in_strict_dataset"), 1)).alias("strict"))


def bundle_issues(bundle: DataFrame, minimum: int) -> DataFrame:
    """(issue): too few events for the bundle's minimum, or events that missed the candidate minimum."""
    counts = bundle.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~_truth(F.col("minimum_met")), 1)).alias("unmet"))
    issues = F.array(F.when(F.col("n") < minimum, F.format_string(f"%d of {minimum} races", "n")), F.when(F.col("unmet") > 0, F.format_string("%d races below the candidate minimum", "unmet")))
    return counts.select(F.explode(F.array_compact(issues)).alias("issue"))


def later_of(manifest: DataFrame, created_at: Column) -> DataFrame:
    """One row: the latest finalisation, the latest data time, and the later of that and the creation, each with the creation as default."""
    data = F.greatest(F.max("entry_finalized_at"), F.max("updated_at"))
    return manifest.agg(
        F.coalesce(F.max("entry_finalized_at"), created_at).alias("entry_finalized_at"),
        F.coalesce(data, created_at).alias("data_at"),
        F.greatest(F.coalesce(data, created_at), created_at).alias("created_at"),
    )


def snapshot_ids(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``snapshot_id``: 16 hex digits of the SHA-256 of the columns as JSON with sorted names."""
    return rows.withColumn("snapshot_id", F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16))


def events_of_date(rows: DataFrame, *order: str) -> DataFrame:
    """(race_date, place, race_id, n): the events of each date in order, with their number."""
    by = Window.partitionBy("race_date")
    return rows.select("race_date", F.row_number().over(by.orderBy(*order)).alias("place"), "race_id", F.count(F.lit(1)).over(by).alias("n"))
