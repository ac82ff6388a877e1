"""Whether a field may be an input, decided from what registries say of it, by precedence.

Each registry column speaks for itself; the strongest voice wins, and the reason says which it was.
Registries that disagree are joined first: of a field named by several, the most careful word counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of a registry, their words, and what words say of an input.
COLUMNS = ["consumer_scope", "availability_stage", "as_of_requirement", "train_inference_flag", "time_boundary_rule", "generated_at_kind", "updated_at_kind", "identifier_pattern"]
SCOPE = "train_inference"
BLOCKING = {
    "train_inference_flag": ["BLOCK"],
    "availability_stage": ["L+1"],
    "as_of_requirement": ["POSTRACE_ONLY"],
    "time_boundary_rule": ["GENERATED_AFTER_RESULT_CONFIRMATION"],
    "generated_at_kind": ["POSTRACE_CONFIRMATION_TIME"],
    "updated_at_kind": ["POSTRACE_CONFIRMATION_TIME"],
}
REVIEWED = {
    "train_inference_flag": ["HOLD"],
    "availability_stage": ["?"],
    "as_of_requirement": ["TIMING_UNVERIFIED"],
    "time_boundary_rule": ["MEASUREMENT_REQUIRED_BEFORE_ENTRY_USE"],
    "generated_at_kind": ["UNVERIFIED_TIME"],
    "updated_at_kind": ["UNVERIFIED_TIME"],
}
BLOCKING_TAG, REVIEWED_TAG = "post_entry_only", "hold"
#: What a flag that allows promises of the other columns; a column that is not named may say anything.
PROMISES = {
    "ALLOW": {"availability_stage": ["L-1", "L0"], "as_of_requirement": ["DIRECT_PRE_RACE"], "time_boundary_rule": ["VALUE_AT_OR_BEFORE_ENTRY_FINALIZED_AT"]},
    "ALLOW_SNAPSHOT_ONLY": {"availability_stage": ["L0 snapshot"], "as_of_requirement": ["PRE_CUTOFF_SNAPSHOT"], "time_boundary_rule": ["SNAPSHOT_CAPTURED_AT_OR_BEFORE_ENTRY_FINALIZED_AT"]},
    "ALLOW_STORED_ONLY": {
        "as_of_requirement": ["STORED_AS_OF_SNAPSHOT", "HISTORICAL_LOOKBACK_BEFORE_RACE_DATE"],
        "time_boundary_rule": ["STORED_ROW_AT_OR_BEFORE_ENTRY_FINALIZED_AT", "LOOKBACK_EVENT_DATE_STRICTLY_BEFORE_RACE_DATE"],
    },
}
STAGES = ["L-1", "L0", "L0 snapshot"]
REASONS = {
    "block_postrace_or_leakage_signal": ("BLOCK", 100),
    "block_non_feature_scope": ("BLOCK", 90),
    "review_unverified_timing_signal": ("REVIEW_REQUIRED", 80),
    "review_inconsistent_allowed_contract": ("REVIEW_REQUIRED", 70),
    "allow_explicit_prerace_contract": ("ALLOW", 10),
    "review_fallback_incomplete_schema": ("REVIEW_REQUIRED", 0),
}


def _said(words: dict[str, list[str]]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(*w), F.lit(False)) for c, w in words.items()])


def _kept(flag: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).isin(*w), F.lit(False)) for c, w in PROMISES[flag].items()])


def decision() -> Column:
    """Struct (verdict, reason, priority) of a registry row with COLUMNS and ``tags``, an array; null words and blank patterns promise nothing."""
    tagged = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
    flag = F.coalesce(F.col("train_inference_flag"), F.lit(""))
    named = F.coalesce(F.trim("identifier_pattern"), F.lit("")) != ""
    broken = reduce(lambda a, b: a | b, [(flag == f) & ~_kept(f) for f in PROMISES])
    # A flag that allows and keeps its promise speaks of a known stage too; other flags allow nothing.
    explicit = flag.isin(*PROMISES) & F.coalesce(F.col("availability_stage").isin(*STAGES), F.lit(False))
    reason = (
        F.when(_said(BLOCKING) | tagged(BLOCKING_TAG), "block_postrace_or_leakage_signal")
        .when(F.coalesce(F.col("consumer_scope"), F.lit("")) != SCOPE, "block_non_feature_scope")
        .when(_said(REVIEWED) | tagged(REVIEWED_TAG), "review_unverified_timing_signal")
        .when(~named | broken, "review_inconsistent_allowed_contract")
        .when(explicit, "allow_explicit_prerace_contract")
        .otherwise("review_fallback_incomplete_schema")
    )
    verdict, priority = (F.coalesce(*[F.when(reason == r, F.lit(v[i])) for r, v in REASONS.items()]) for i in (0, 1))
    return F.struct(verdict.alias("verdict"), reason.alias("reason"), priority.alias("priority"))


def decided_fields(registries: DataFrame) -> DataFrame:
    """(field_path, verdict, reason, priority, words) of every field: the decision of highest priority over all rows that name it.

    Of a block, a review and an allowance the block wins, then the review; ``words`` says how many
    rows differ from the winning verdict. Frequent fields are reduced before the shuffle.
    """
    order = {"BLOCK": 2, "REVIEW_REQUIRED": 1, "ALLOW": 0}
    one = registries.select("field_path", F.inline(F.array(decision())))
    weight = F.coalesce(*[F.when(F.col("verdict") == v, F.lit(n)) for v, n in order.items()])
    counts = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in order]
    best = one.groupBy("field_path").agg(F.max(F.struct(weight.alias("n"), "priority", "verdict", "reason")).alias("best"), F.count(F.lit(1)).alias("rows"), *counts)
    same = F.coalesce(*[F.when(F.col("best.verdict") == v, F.col(v)) for v in order])
    return best.select("field_path", "best.verdict", "best.reason", "best.priority", (F.col("rows") - same).alias("words"))
