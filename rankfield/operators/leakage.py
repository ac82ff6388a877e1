"""Fields that are known only after an event, found at any depth of JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RESULT_FIELDS = ["rank", "ord", "rcTime", "result", "resultTime", "finish_position", "top3", "actual_result", "dividend", "payout", "diffUnit", "rankRise"]
SECTIONAL = r"^(sj|bu|se)(G[1-8]f|S[12]f|_[1-4]c)(Ord|AccTime|GTime)$"


def forbidden(key: Column) -> Column:
    """Whether a field name is one of a result or of a section of the course."""
    return key.isin(*RESULT_FIELDS) | key.rlike(SECTIONAL)


def meaningful(value: Column) -> Column:
    """Whether a variant says anything: no null, no blank text, no empty list or object."""
    said = F.to_json(value)
    return value.isNotNull() & ~said.isin("null", "[]", "{}") & ~said.rlike(r'^"(\s|\\[tnrf])*"$')


def leaked_fields(documents: DataFrame, key: str, document: str, depth: int = 12) -> DataFrame:
    """(key, path) of every forbidden field with a meaningful value; array places are numbered from 0.

    A level at a time: members of objects and arrays are unnested once, forbidden ones go on with
    their path and their inside is searched too. All levels are one pass over the documents, without
    a shuffle. Members deeper than ``depth`` levels are an error. Texts that are no JSON, and nulls,
    leak nothing.
    """
    spread = documents.sparkSession.tvf.variant_explode_outer
    state = "struct<path:string,v:variant,found:boolean>"
    level = documents.select(key, F.lit("").alias("path"), F.try_parse_json(document).alias("v"), F.lit(False).alias("found")).filter(F.col("v").isNotNull())
    for _ in range(depth + 1):
        outer = level.select(F.col(key).alias("_key"), F.col("path").alias("_path"), F.col("v").alias("_v"), F.col("found").alias("_found"))
        inner = outer.lateralJoin(spread(F.col("_v").outer()))
        name = F.when(F.col("key").isNull(), F.concat(F.col("_path"), F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        name = name.when(F.col("_path") == "", F.col("key")).otherwise(F.concat_ws(".", "_path", "key"))
        # A field that was found goes on as it is; a member goes on with its inside, and once more if it is a find.
        member, none = ~F.col("_found") & F.col("pos").isNotNull(), F.lit(None).cast("variant")
        bad = member & forbidden(F.col("key")) & meaningful(F.col("value"))
        onward = F.array(
            F.when(F.col("_found"), F.struct(F.col("_path"), none, F.lit(True)).cast(state)),
            F.when(bad, F.struct(name, none, F.lit(True)).cast(state)),
            F.when(member, F.struct(name, F.col("value"), F.lit(False)).cast(state)),
        )
        level = inner.select(F.col("_key").alias(key), F.explode(F.array_compact(onward)).alias("_on")).select(key, "_on.path", "_on.v", "_on.found")
    kind = F.schema_of_variant("v")
    deeper = (kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~F.to_json("v").isin("[]", "{}")
    beyond = F.raise_error(F.concat(F.lit(f"deeper than {depth} levels: "), "path")).cast("string")
    return level.filter(F.col("found") | deeper).select(key, F.when(F.col("found"), F.col("path")).otherwise(beyond).alias("path"))


def leakage_report(documents: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """One row (passed, issues, leaking, checked): distinct issues, documents with one, documents looked at."""
    checked = documents.agg(F.count(F.lit(1)).alias("checked"))
    said = issues.distinct().agg(F.count(F.lit(1)).alias("issues"), F.count_distinct(key).alias("leaking"))
    return checked.join(said).select((F.col("issues") == 0).alias("passed"), "issues", "leaking", "checked")  # two single rows
