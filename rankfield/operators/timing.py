"""When a snapshot was ready, whether it may be replayed, and whether an event may be held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfield.functions.clean import start_at

# Minutes before the start.
ENTRY_BUFFER_MINUTES, RELEASE_CUTOFF_MINUTES = 10, 30


def minutes_before(at: Column, minutes: int) -> Column:
    """``at`` less some minutes."""
    return at - F.expr(f"INTERVAL {minutes} MINUTES")


def snapshot_metadata(override: Column, collected: Column, row_collected: Column, row_updated: Column, start: Column, sources_present: Column) -> Column:
    """Struct (finalized_at, field, source, confidence, replay_status, strict) by the precedence of the timestamps."""
    cutoff = minutes_before(start, ENTRY_BUFFER_MINUTES)
    ladder = [
        (override, "entry_finalized_at_override", "source_revision", "high"),
        (collected, "basic_data.collected_at", "snapshot_collected_at", "medium"),
        (row_collected, "races.collected_at", "snapshot_collected_at", "medium"),
        (cutoff, "race_plan.sch_st_time_minus_10m", "derived_from_schedule", "low"),
        (row_updated, "races.updated_at", "fallback_collected_only", "low"),
    ]
    pick = lambda n, default: F.coalesce(*[F.when(at.isNotNull(), F.lit(names[n])) for at, *names in ladder], F.lit(default))
    final, source = F.coalesce(*[at for at, *_ in ladder]), pick(1, "fallback_collected_only")
    status = (
        F.when(final.isNull(), "missing_timestamp")
        .when(~sources_present, "partial_snapshot")
        .when(final > cutoff, "late_snapshot_unusable")
        .when(source.isin("source_revision", "snapshot_collected_at"), "strict")
        .otherwise("degraded")
    )
    return F.struct(
        final.alias("finalized_at"),
        pick(0, "missing_timestamp").alias("field"),
        source.alias("source"),
        pick(2, "low").alias("confidence"),
        status.alias("replay_status"),
        status.isin("strict", "degraded").alias("strict"),
    )


def release_cutoff(date_text: Column, time_text: Column, snapshot_at: Column, minutes: int = RELEASE_CUTOFF_MINUTES) -> Column:
    """pass, or why a source snapshot is not usable for a release before the start."""
    start = start_at(date_text, time_text)
    return (
        F.when(start.isNull(), F.when(F.coalesce(time_text, F.lit("")) == "", "missing_scheduled_start").otherwise("invalid_scheduled_start"))
        .when(snapshot_at.isNull(), "missing_source_snapshot")
        .when(snapshot_at > minutes_before(start, minutes), "source_after_cutoff")
        .otherwise("pass")
    )


def holdout_exclusion(result_status: Column, has_basic: Column, meta: Column, active: Column, top3: Column, leaks: Column) -> Column:
    """Why an event is not held out, by precedence; null for those that are."""
    return (
        F.when(F.coalesce(result_status != "collected", F.lit(True)), "missing_result_data")
        .when(~has_basic, "missing_basic_data")
        .when(~meta["strict"], meta["replay_status"])
        .when(F.size(active) < 3, "insufficient_active_runners")
        .when((F.size(top3) != 3) | (F.size(F.array_distinct(top3)) != 3), "invalid_top3_result")
        .when(F.size(F.array_except(top3, active)) > 0, "top3_not_in_active_runners")
        .when(leaks, "leakage_violation")
    )
