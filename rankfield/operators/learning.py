"""Models, resampling statistics and feature coverage on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.sources.staging import staged

SEED = 42
#: Distinct values whose counts may come to the driver.
MOST_VALUES = 100_000


def model(kind: str, features: list[str], label: str = "target", weight: str | None = None) -> Pipeline:
    """Median imputer and one of gbt, rf, logreg. Results differ numerically from other libraries' models of the same name."""
    filled = [f"_{f}" for f in features]
    extra = {"weightCol": weight} if weight else {}
    last = {
        "gbt": lambda: GBTClassifier(labelCol=label, seed=SEED, maxIter=20, maxDepth=4, **extra),
        "rf": lambda: RandomForestClassifier(labelCol=label, seed=SEED, numTrees=20, maxDepth=6, **extra),
        "logreg": lambda: LogisticRegression(labelCol=label, maxIter=50, regParam=0.01, **extra),
    }[kind]()
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), last])


def balanced_weight(rows: DataFrame, label: str = "target") -> Column:
    """Weights that make both classes count the same; the two counts come to the driver."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    return F.coalesce(*[F.when(F.col(label) == k, F.lit(total / (len(counts) * n))) for k, n in counts.items()])


def scored(fitted: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with the probability of class 1."""
    return fitted.transform(rows).select(*keep, vector_to_array("probability")[1].alias("score"))


def group_fold(group: Column, folds: int) -> Column:
    """A fold of a group by hash; all rows of a group share it."""
    return F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")


def feature_coverage(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, present, missing, rate), in one pass over the rows."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("present"), (F.col("_n") - F.col(f)).alias("missing"), F.try_divide(F.col(f), F.col("_n")).alias("rate")) for f in features])
    return counts.select(F.inline(pairs))


def value_counts(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of a measure with few distinct values, such as a hit rate in thirds; more than MOST_VALUES are refused."""
    found = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise ValueError(f"{value} has more than {MOST_VALUES} distinct values; round it first")
    found.sort(key=lambda r: (r[value] is not None, r[value] or 0))
    return np.array([r[value] for r in found], dtype=float), np.array([r["n"] for r in found], dtype=np.int64)


def bootstrap_mean(rows: DataFrame, value: str, confidence: float = 0.95, rounds: int = 10_000) -> DataFrame:
    """One row (mean, low, high) of a percentile bootstrap.

    Resampling n rows with replacement draws multinomial counts of the distinct values, so only the
    histogram of the measure leaves the cluster, whatever the number of rows.
    """
    values, counts = value_counts(rows, value)
    spark = rows.sparkSession
    if not len(values):
        return spark.createDataFrame([(0.0, 0.0, 0.0)], "mean double, low double, high double")
    n = int(counts.sum())
    means = np.random.default_rng(SEED).multinomial(n, counts / n, size=rounds) @ values / n
    low, high = np.percentile(means, [50 * (1 - confidence), 50 * (1 + confidence)])
    return spark.createDataFrame([(float(values @ counts / n), float(low), float(high))], "mean double, low double, high double")


def _poisson_steps() -> np.ndarray:
    """The Poisson distribution function of mean 1 at 0, 1, 2, ..., as far as 53 bits tell it from 1."""
    terms = np.cumprod(np.concatenate([[np.exp(-1.0)], 1 / np.arange(1, 20)]))
    return np.cumsum(terms)


def _replicate_sums(rounds: int, seed: int):
    steps, cells = _poisson_steps(), 1_000_000

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each replicate: how often rows of this task were drawn, and the sum of what they hold."""
        number = np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        drawn, total, some = np.zeros(rounds, np.int64), np.zeros(rounds), False
        for batch in batches:
            keys, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(keys), max(1, cells // rounds)):
                part = slice(at, at + max(1, cells // rounds))
                mixed = keys[part, None] ^ number
                for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(odd)
                weight = np.searchsorted(steps, ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")
                drawn += weight.sum(0)
                total += values[part] @ weight
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(drawn), pa.array(total)], names=["replicate", "n", "total"])

    return sums


def poisson_bootstrap(rows: DataFrame, value: Column, key: list[str], confidence: float = 0.95, rounds: int = 1000) -> DataFrame:
    """One row (mean, low, high): a percentile bootstrap of any measure, continuous ones too, in one pass over the rows.

    In each replicate a row counts as often as a Poisson number of mean 1 says, which follows from
    its ``key`` and the replicate, so nothing depends on how rows are divided; rows of one key count
    together. Tasks sum up replicates, and ``rounds`` rows come to the driver, whatever the number of
    rows. Rows without a value are left out; without rows all three are 0. Runs when called.
    """
    spark = rows.sparkSession
    held = rows.select(F.xxhash64(*key).alias("key"), value.cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    held = staged(held, "resampled")  # the mean and the replicates read it, so that what made it runs once
    whole = held.agg(F.avg("value").alias("mean")).first()["mean"]
    parts = held.mapInArrow(_replicate_sums(rounds, SEED), "replicate int, n long, total double")
    found = parts.groupBy("replicate").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0").collect()
    if not found:
        return spark.createDataFrame([(0.0, 0.0, 0.0)], "mean double, low double, high double")
    low, high = np.percentile([r["total"] / r["n"] for r in found], [50 * (1 - confidence), 50 * (1 + confidence)])
    return spark.createDataFrame([(float(whole), float(low), float(high))], "mean double, low double, high double")


def paired_bootstrap(rows: DataFrame, a: str, b: str, confidence: float = 0.95) -> DataFrame:
    """As bootstrap_mean, of the paired differences b - a."""
    return bootstrap_mean(rows.select(F.round(F.col(b) - F.col(a), 9).alias("_d")), "_d", confidence)
