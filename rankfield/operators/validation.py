"""Row and event validation: issue lists, exclusion reasons and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusion_reasons(entry_no: str, group: str, age: Column, burden_outlier: Column, core_missing: Column) -> Column:
    """Reasons for which an entry is left out of an event; missing core fields count only where there is no other reason."""
    repeated = F.col(entry_no).isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy(group, entry_no)) > 1)
    hard = F.array_compact(F.array(F.when(repeated, "chul_no_duplicate"), F.when(F.coalesce(age <= 0, F.lit(False)), "age_invalid"), F.when(burden_outlier, "wg_budam_outlier")))
    return F.when((F.size(hard) == 0) & core_missing, F.array(F.lit("core_missing"))).otherwise(hard)


def partition_entries(rows: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(active, excluded) entries."""
    return rows.filter(F.size(reasons) == 0), rows.filter(F.size(reasons) > 0)


def reason_audit(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    """(reason, n) over all entries."""
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def missing_fields(fields: list[str]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields]))


def event_verdict(entries: Column, quality: Column, bad_odds: Column, least_entries: int, least_quality: float) -> Column:
    """passed, or the first check of an event that fails."""
    return (
        F.when(entries < least_entries, "too_few_entries")
        .when(quality < least_quality, "low_quality")
        .when(bad_odds > 0, "invalid_odds")
        .otherwise("passed")
    )


def id_mismatches(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids in one set only: missing or unexpected."""
    missing = expected.select(key).join(found.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select(key).join(expected.select(key), key, "left_anti").withColumn("side", F.lit("unexpected"))).distinct()
