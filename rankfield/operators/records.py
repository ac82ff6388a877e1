"""Records of runs, artifacts, requests and chains: lookups by precedence, checks and status ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfield.functions import clean

# Fixed values.
CONDITIONS = {"heavy": (0.95, 1.2, 1.1), "soft": (0.95, 1.2, 1.1), "firm": (1.05, 0.9, 1.0)}
RELEASE, SEEDS, TERMINAL_ACTION = "RELEASE", 10, "implement_runner"


def first_path(document: Column, paths: list[str]) -> Column:
    """Struct (value, source): the first of dotted paths of a JSON document that holds a number, and its name; nulls if none does."""
    found = [(p, clean.number(F.get_json_object(document, f"$.{p}"))) for p in paths]
    return F.struct(F.coalesce(*[v for _, v in found]).alias("value"), F.coalesce(*[F.when(v.isNotNull(), p) for p, v in found]).alias("source"))


def seed_of(override: Column, document: Column, paths: list[str]) -> Column:
    """Struct (seed, source): the override, else the first path of the document that holds a whole number."""
    found = first_path(document, paths)
    return F.struct(
        F.coalesce(clean.whole(override), clean.whole(found["value"])).alias("seed"),
        F.when(clean.whole(override).isNotNull(), "override").otherwise(found["source"]).alias("source"),
    )


def artifact_checks(reference: DataFrame, other: DataFrame, key: str = "label") -> DataFrame:
    """(label, matched, difference) of artifacts (label, sha256, byte_size): a match has both digests and equal sizes."""
    a = reference.select(key, F.col("sha256").alias("_a"), F.col("byte_size").alias("_m"), F.lit(1).alias("_in_a"))
    b = other.select(key, F.col("sha256").alias("_b"), F.col("byte_size").alias("_n"), F.lit(1).alias("_in_b"))
    joined = a.join(b, key, "full")
    matched = F.coalesce((F.col("_a") == F.col("_b")) & F.col("_m").eqNullSafe(F.col("_n")), F.lit(False))
    difference = F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), "missing_artifact").when(~matched, "artifact_hash_mismatch")
    return joined.select(key, matched.alias("matched"), difference.alias("difference"))


def standard_rows(rows: DataFrame, metric: str, *, maximize: bool = True) -> DataFrame:
    """``rows`` (run_id, seed_index, value as text) with the metric's status, issue and normalised values."""
    return rows.withColumn("metric", F.lit(metric)).withColumn("_m", clean.metric_value(F.col("value"), maximize=maximize)).select(*rows.columns, "metric", "_m.*")


def metric_summary(rows: DataFrame) -> DataFrame:
    """(metric, rows, ok, missing, abnormal, mean, least) over standard rows."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), of("ok").alias("ok"), of("missing").alias("missing"), of("abnormal").alias("abnormal"), F.avg("normalized").alias("mean"), F.min("comparable").alias("least")
    )


def seed_issue(seeds: Column, allow_empty: bool = False) -> Column:
    """What is wrong with an array of seeds: there are ten, all different."""
    n = F.coalesce(F.size(seeds), F.lit(0))
    return F.when((n == 0) & F.lit(allow_empty), None).when(n != SEEDS, "seeds must be ten").when(F.size(F.array_distinct(seeds)) != n, "seeds must be distinct")


def request_issue(date: Column, today: Column) -> Column:
    """What is wrong with a requested date: eight digits, a real day, none of the future."""
    day = F.try_to_timestamp(date, F.lit("yyyyMMdd")).cast("date")
    return F.when(~F.coalesce(date.rlike(r"^\d{8}$"), F.lit(False)), "format").when(day.isNull(), "no such day").when(day > today, "future")


def cutoff(before: Column, keep_months: Column, today: Column) -> Column:
    """Struct (cutoff, issue): of exactly one of a date and a number of months."""
    given = F.coalesce(before != "", F.lit(False))
    months = F.coalesce(keep_months >= 1, F.lit(False))
    first = F.date_format(F.add_months(F.trunc(today, "month"), 1 - keep_months), "yyyyMMdd")
    return F.struct(
        F.when(given & ~months, before).when(months & ~given, first).alias("cutoff"), F.when(given & months, "both given").when(~given & ~months, "none given").alias("issue")
    )


def weather_effect(condition: Column) -> Column:
    """Struct of three multipliers (speed, stamina, weight) of a track condition; 1 for others."""
    names = ["speed", "stamina", "weight"]
    return F.struct(*[F.coalesce(clean.coded(condition, {c: v[i] for c, v in CONDITIONS.items()}), F.lit(1.0)).alias(n) for i, n in enumerate(names)])


def source_status(blocks: dict[str, Column], keys_only: dict[str, Column]) -> Column:
    """Map of sources to present or missing: a block must hold something, of some the key alone is enough."""
    has = {n: F.coalesce((F.size(c) > 0), F.lit(False)) for n, c in blocks.items()} | {n: F.coalesce(c, F.lit(False)) for n, c in keys_only.items()}
    return F.create_map(*[x for n, c in has.items() for x in (F.lit(n), F.when(c, "present").otherwise("missing"))])


def node_status(exists: Column, status: Column) -> Column:
    """The status of a chain's node from its artifact."""
    return F.when(~F.coalesce(exists, F.lit(False)), "missing").when(status == "passed", "passed").when(status.startswith("blocked"), "blocked").otherwise("failed")


def next_action(nodes: DataFrame) -> DataFrame:
    """(chain, depth, action): of the first node that has not passed and names an action, else of the first not passed, else the last step."""
    by = Window.partitionBy("chain").orderBy((F.col("status") == "passed").cast("int"), F.col("action").isNull().cast("int"), "depth")
    first = nodes.withColumn("_n", F.row_number().over(by)).filter("_n = 1")
    passed = F.col("status") == "passed"
    action = F.when(passed, TERMINAL_ACTION).otherwise(F.coalesce("action", F.concat(F.lit("make_"), "artifact")))
    return first.select("chain", F.when(~passed, F.col("depth")).alias("depth"), action.alias("action"))


def live_scope(rows: DataFrame) -> DataFrame:
    """(race_id, date): the explicit id, else date, meet and number joined."""
    made = F.concat_ws("_", "date", "meet", "number")
    return rows.select(F.coalesce(clean.text(F.col("race_id")), made).alias("race_id")).withColumn("date", F.substring("race_id", 1, 8))


def overlay_contract(spark: SparkSession, path: str) -> DataFrame:
    """A contract CSV (feature_name, release_bucket, model_feature_status, ...) with its header; names that stand twice are an error."""
    rows = spark.read.option("header", True).csv(path)
    twice = F.count(F.lit(1)).over(Window.partitionBy("feature_name")) > 1
    name = F.when(twice, F.raise_error(F.concat(F.lit("duplicate feature: "), "feature_name")).cast("string")).otherwise(F.col("feature_name"))
    return rows.withColumn("feature_name", name)


def overlay_names(contract: DataFrame, *, current_only: bool = False) -> DataFrame:
    """(feature_name) of the release bucket, with ``current_only`` those that the model has."""
    chosen = contract.filter(F.col("release_bucket") == RELEASE)
    return (chosen.filter(F.col("model_feature_status") == "current_model_input") if current_only else chosen).select("feature_name")


def overlay_violations(selected: DataFrame, contract: DataFrame) -> DataFrame:
    """(feature_name, release_bucket) of selected features that the contract keeps from releases; unlisted ones are no matter."""
    return selected.select("feature_name").distinct().join(contract.filter(F.col("release_bucket") != RELEASE).select("feature_name", "release_bucket"), "feature_name")


def meaningful(value: Column, is_container: Column, size: Column) -> Column:
    """Whether a value says anything: not null, not blank, no empty container."""
    return F.coalesce(F.when(is_container, size > 0).otherwise(F.trim(value) != ""), F.lit(False))


def cleaned_map(block: Column, *, numeric: bool) -> Column:
    """A block of text values, trimmed and blank ones null, as numbers not below 0 where they are such if ``numeric``."""
    def one(_, v: Column) -> Column:
        text = clean.text(v)
        return F.coalesce(clean.nonnegative_number(text).cast("string"), text) if numeric else text

    return F.transform_values(block, one)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, sha256) of files, each read where it lies; the source does not list empty files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
