"""The queries without SQL, executed: the fitted model and the resampled intervals; and edge rows of the core operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfield.operators import jobs, learning, splits
from rankfield.operators.evaluation import mcnemar
from rankfield.operators.history import rolling_history
from rankfield.plans import QUERIES
from rankfield.plans.prediction import outcomes
from rankfield.sources.documents import leaf_paths


def test_model_top3(spark, data):
    rows = {r["hit_count"]: r["races"] for r in QUERIES["model_top3"](spark, data).collect()}
    again = {r["hit_count"]: r["races"] for r in QUERIES["model_top3"](spark, data).collect()}
    from rankfield.plans.prediction import scored

    late = scored(spark, data).filter("race_date >= '1998-01-01'").groupBy("race_id").count()
    assert rows == again and set(rows) <= {0, 1, 2, 3} and sum(rows.values()) == late.count()
    least = late.select(F.greatest(F.lit(0), 6 - F.col("count")).alias("m")).filter("m <= 3").agg(F.avg("m")).first()[0]
    assert sum(k * n for k, n in rows.items()) / sum(rows.values()) >= least  # never below what two sets of three must share


def test_hit_rate_interval(spark, data):
    values = np.array([r[0] for r in outcomes(spark, data).select(F.col("hit_count") / 3).collect()])
    row = QUERIES["hit_rate_interval"](spark, data).first()
    means = np.random.default_rng(1).choice(values, (2000, len(values))).mean(axis=1)
    assert abs(row["mean"] - values.mean()) < 1e-12
    assert np.allclose([row["low"], row["high"]], np.percentile(means, [2.5, 97.5]), atol=0.005)


def test_paired_difference_interval(spark, data):
    pairs = outcomes(spark, data).select(F.col("hit_count") / 3, F.col("winner").cast("double")).collect()
    gaps = np.array([b - a for a, b in pairs])
    row = QUERIES["paired_difference_interval"](spark, data).first()
    means = np.random.default_rng(2).choice(gaps, (2000, len(gaps))).mean(axis=1)
    assert abs(row["mean"] - gaps.mean()) < 1e-8
    assert np.allclose([row["low"], row["high"]], np.percentile(means, [2.5, 97.5]), atol=0.01)


def test_rows_without_key_or_date_keep_their_place(spark):
    day = dt.date(2024, 1, 10)
    rows = spark.createDataFrame([("a", day, 1), ("a", dt.date(2024, 1, 5), 2), (None, day, 3), ("a", None, 4), (None, None, 5)], "k string, d date, v long")
    found = {r["v"]: r["s"] for r in rolling_history(rows, "k", "d", {"": 30}, {"s": F.col("v")}).collect()}
    assert found == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0}
    placed = {r["v"]: (r["position"], r["total"]) for r in splits.positions(rows, "d", ["v"]).collect()}
    assert placed == {2: (0, 5), 1: (1, 5), 3: (2, 5), 4: (3, 5), 5: (4, 5)}


def test_bounds_are_refused_not_cut(spark, monkeypatch):
    monkeypatch.setattr(learning, "MOST_VALUES", 3)
    with pytest.raises(ValueError, match="distinct values"):
        learning.bootstrap_mean(spark.range(5).select(F.col("id").cast("double").alias("v")), "v")
    monkeypatch.setattr(splits, "MOST_WINDOWS", 1)
    windows = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 3)], "name string, train_end int, eval_start int, eval_end int")
    with pytest.raises(ValueError, match="windows"):
        splits.window_membership(spark.createDataFrame([(1,)], "d int"), "d", windows)


def test_no_leaf_is_lost(spark):
    deep = "{" + '"a":{' * 8 + '"b":1' + "}" * 9
    rows = spark.createDataFrame([(1, deep)], "id int, doc string")
    assert [r["path"] for r in leaf_paths(rows, "id", "doc").collect()] == [".".join("a" * 8) + ".b"]
    with pytest.raises(Exception, match="deeper than 3 levels"):
        leaf_paths(rows, "id", "doc", 3).collect()


def test_strict_words(spark):
    rows = spark.createDataFrame([("collect_race",), (None,)], "w string")
    assert [r[0] for r in rows.select(jobs.job_kind(F.col("w"), strict=True)).collect()] == ["collection", None]
    unknown = spark.createDataFrame([("nothing",)], "w string")
    assert unknown.select(jobs.job_kind(F.col("w"))).first()[0] is None
    with pytest.raises(Exception, match="unknown job kind: nothing"):
        unknown.select(jobs.dispatch_action(F.col("w"), strict=True)).collect()


def test_mcnemar_without_discordant_pairs(spark):
    rows = spark.createDataFrame([(True, True), (False, False)], "a boolean, b boolean")
    assert tuple(mcnemar(rows, "a", "b").first()) == (0, 0, 0.0, 1.0)
