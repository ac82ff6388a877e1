"""Seeded evaluation runs: expected against recorded, outliers, and comparison of two result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def execution_matrix(spark, seeds: list[int]) -> DataFrame:
    """(seed_index, seed, run_id): one run per seed; seeds must be distinct."""
    if len(set(seeds)) != len(seeds):
        raise ValueError("seeds must be distinct")
    rows = [(i + 1, seed, f"seed_{i + 1:02d}_rs{seed}") for i, seed in enumerate(seeds)]
    return spark.createDataFrame(rows, "seed_index int, seed long, run_id string")


def expected_rows(expected: DataFrame, records: DataFrame, key: str = "run_id", status: str = "status") -> DataFrame:
    """Every expected run with its record; state ``missing`` where there is none."""
    joined = expected.join(records, key, "left")
    return joined.withColumn(status, F.coalesce(status, F.lit("missing")))


def outlier_label(value: Column, lower: Column, upper: Column) -> Column:
    """low, high or null by the fences."""
    return F.when(value < lower, "low").when(value > upper, "high")


def with_outliers(rows: DataFrame, value: str, iqr: float = 1.5) -> DataFrame:
    """``rows`` with ``outlier``; the two fences are one row, joined back."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    fences = rows.agg(q.alias("_q")).select((F.col("_q")[0] - iqr * (F.col("_q")[1] - F.col("_q")[0])).alias("_lo"), (F.col("_q")[1] + iqr * (F.col("_q")[1] - F.col("_q")[0])).alias("_hi"))
    return rows.join(F.broadcast(fences)).withColumn("outlier", outlier_label(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def compare(reference: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, differing) of two tables: matched, mismatched, missing or unexpected, with the names of differing fields."""
    a = reference.select(key, F.struct(*fields).alias("_a"))
    b = other.select(key, F.struct(*fields).alias("_b"))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.size(differing) == 0, "matched").otherwise("mismatched")
    joined = a.join(b, key, "full").withColumn("state", state)
    return joined.select(key, "state", F.when(F.col("state") == "mismatched", differing).otherwise(F.array().cast("array<string>")).alias("differing"))


def first_sequence_difference(reference: DataFrame, other: DataFrame, position: str, value: str) -> DataFrame:
    """One row: the first position at which two sequences differ (null if none) and both lengths."""
    a = reference.select(position, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    b = other.select(position, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    joined = a.join(b, position, "full")
    differs = ~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return joined.agg(F.min(F.when(differs, F.col(position))).alias("first_difference"), F.count("_in_a").alias("reference_length"), F.count("_in_b").alias("other_length"))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON (keys in order) of some columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def promotion_gate(strict: bool, logloss_better: Column, ece_no_worse: Column, top3_better: Column, roi_better: Column) -> Column:
    """Whether a challenger replaces the champion."""
    if strict:
        return logloss_better & ece_no_worse & (top3_better | roi_better)
    votes = logloss_better.cast("int") + top3_better.cast("int") + roi_better.cast("int")
    return ece_no_worse & (votes >= 2)
