"""Fits and their evaluation over several windows of time, on one staged table of feature rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.operators import learning as L
from rankfield.operators import ranking as R
from rankfield.operators.evaluation import hits


@dataclass(frozen=True)
class Span:
    """Rows up to ``train_end`` are learned from; those from ``eval_start`` (None: after train_end) to ``eval_end`` (None: no end) are predicted."""

    name: str
    train_end: str
    eval_start: str | None = None
    eval_end: str | None = None

    def trains(self) -> Column:
        return F.col("race_date") <= F.lit(self.train_end).cast("date")

    def evaluates(self) -> Column:
        begun = F.col("race_date") > F.lit(self.train_end).cast("date") if self.eval_start is None else F.col("race_date") >= F.lit(self.eval_start).cast("date")
        return begun if self.eval_end is None else begun & (F.col("race_date") <= F.lit(self.eval_end).cast("date"))


def check_spans(rows: DataFrame, spans: list[Span]) -> None:
    """Raise unless every span has rows of both kinds; one pass over the dates."""
    counts = rows.agg(*[F.count(F.when(c, 1)).alias(f"{kind}{i}") for i, s in enumerate(spans) for kind, c in (("t", s.trains()), ("e", s.evaluates()))]).first()
    for i, span in enumerate(spans):
        if not counts[f"t{i}"] or not counts[f"e{i}"]:
            raise ValueError(f"{span.name} has an empty part: learned from {counts[f't{i}']} rows, predicted {counts[f'e{i}']}")


def predicted_spans(rows: DataFrame, features: list[str], spans: list[Span], kind: str = "logreg", positive_weight: float = 1.0, at_once: int = 4) -> DataFrame:
    """(span, race_id, predicted, answer, hit_count): three picks of every predicted event of every span.

    ``rows`` (race_id, race_date, entry_no, place, target and features) should be a staged table: it
    is read once for each fit and once for each prediction, and nothing before it is computed again.
    Spans are fitted ``at_once`` side by side; rows of class 1 weigh ``positive_weight``. Picks go by
    score, then by the larger number. An event without three known places has no answer and 0 hits.
    """
    check_spans(rows, spans)

    @inheritable_thread_target(rows.sparkSession)
    def fit(span: Span):
        weighed = rows.filter(span.trains()).withColumn("w", F.when(F.col("target") == 1, positive_weight).otherwise(1.0))
        return L.model(kind, features, weight="w").fit(weighed)

    pool = ThreadPool(min(at_once, len(spans)))
    try:
        fitted = pool.map(fit, spans)
    finally:
        pool.close()
    parts = [
        L.scored(model, rows.filter(span.evaluates()), ["race_id", "entry_no", "place"]).withColumn("span", F.lit(span.name))
        for span, model in zip(spans, fitted, strict=True)
    ]
    scored = reduce(DataFrame.unionByName, parts).withColumn("key", F.struct("span", "race_id"))
    picks = R.top_k_lists(scored, "key", "entry_no", 3, F.desc("score"), F.desc("entry_no"))
    known = scored.filter(F.col("place") <= 3)
    answers = R.top_k_lists(known, "key", "entry_no", 3, F.asc("place"), F.asc("entry_no"), name="answer")
    whole = picks.join(answers.filter(F.size("answer") == 3), "key", "left")
    return whole.select("key.span", "key.race_id", "predicted", "answer", F.coalesce(hits(F.col("predicted"), F.col("answer")), F.lit(0)).alias("hit_count"))


def span_rates(predicted: DataFrame) -> DataFrame:
    """(span, races, incomplete, exact_rate, set_match) of the answered events; ``incomplete`` ones lack three picks."""
    answered = predicted.filter(F.col("answer").isNotNull())
    return answered.groupBy("span").agg(
        F.count(F.lit(1)).alias("races"),
        F.count(F.when(F.size("predicted") < 3, 1)).alias("incomplete"),
        F.avg((F.col("hit_count") == 3).cast("int")).alias("exact_rate"),
        F.avg(F.col("hit_count") / 3).alias("set_match"),
    )


def overfit_safe(rates: DataFrame, dev: str, test: str) -> DataFrame:
    """One row (robust, blended, rolling_min, rolling_mean, overfit_safe) of exact rates, each to six places.

    Robust is the lower one of the dev and the test span, blended their mean; the other spans roll.
    Without rolling spans their least and mean rates are the robust one.
    """
    rate, rolling = F.round("exact_rate", 6), ~F.col("span").isin(dev, test)
    sums = rates.agg(
        F.max(F.when(F.col("span") == dev, rate)).alias("dev"), F.max(F.when(F.col("span") == test, rate)).alias("test"), F.min(F.when(rolling, rate)).alias("least"), F.avg(F.when(rolling, rate)).alias("mean")
    )
    robust = F.round(F.least("dev", "test"), 6)
    least = F.coalesce(F.round("least", 6), robust)
    return sums.select(
        robust.alias("robust"),
        F.round((F.col("dev") + F.col("test")) / 2, 6).alias("blended"),
        least.alias("rolling_min"),
        F.coalesce(F.round("mean", 6), robust).alias("rolling_mean"),
        F.round(F.least(robust, least), 6).alias("overfit_safe"),
    )
