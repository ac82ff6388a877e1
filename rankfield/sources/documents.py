"""Envelopes and documents in JSON or XML, polymorphic results, and archive sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "struct<no:string,name:string,odds:string>"


@F.pandas_udf(T.StringType())
def decoded(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as text: UTF-8, else EUC-KR, else UTF-8 with replacements. Spark's charset functions reject EUC-KR."""

    def one(value) -> str | None:
        if value is None:
            return None
        for charset in ("utf-8", "euc-kr"):
            try:
                return bytes(value).decode(charset)
            except UnicodeDecodeError:
                continue
        return bytes(value).decode("utf-8", "replace")

    for batch in raw:
        yield batch.map(one)


def scalar(text: Column) -> Column:
    """Struct (whole, fraction, word) of an XML scalar: leading zeros stay text, blank is null."""
    value = F.nullif(F.trim(text), F.lit(""))
    is_word = value.rlike(r"^0\d")
    whole = F.when(~is_word & value.rlike(r"^-?\d+$"), value.try_cast("long"))
    fraction = F.when(~is_word & value.contains("."), value.try_cast("double"))
    return F.struct(whole.alias("whole"), fraction.alias("fraction"), F.when(whole.isNull() & fraction.isNull(), value).alias("word"))


def items(payload: Column, item: str = ITEM) -> Column:
    """response.body.items.item as an array: an object is wrapped, a missing level is empty; text that begins with < is XML."""
    from_json = F.from_json(F.get_json_object(payload, "$.response.body.items.item"), f"array<{item}>")  # a lone object is an array of one
    from_xml = F.from_xml(payload, f"body struct<items:struct<item:array<{item}>>>")["body"]["items"]["item"]
    return F.coalesce(F.when(F.ltrim(payload).startswith("<"), from_xml).otherwise(from_json), F.array().cast(f"array<{item}>"))


def successful(payload: Column) -> Column:
    """Whether there is a response whose code is empty or 00."""
    code = F.coalesce(F.get_json_object(payload, "$.response.header.resultCode"), F.lit(""))
    return F.get_json_object(payload, "$.response").isNotNull() & code.isin("", "00")


def result_top3(document: Column) -> Column:
    """The placed entries of a result in any of its shapes: a list, {top3}, {horses} or {result}; empty if there are none."""

    def by_shape(doc: Column, deeper: bool) -> Column:
        as_list = F.when(F.ltrim(doc).startswith("["), F.from_json(doc, "array<int>"))
        top3 = F.from_json(F.get_json_object(doc, "$.top3"), "array<int>")
        horses = F.from_json(F.get_json_object(doc, "$.horses"), "array<struct<chulNo:int,ord:int>>")
        placed = F.array_sort(F.filter(horses, lambda h: h["ord"] > 0), lambda a, b: a["ord"] - b["ord"])
        inner = F.get_json_object(doc, "$.result")
        found = [as_list, top3, F.when(horses.isNotNull(), F.slice(F.transform(placed, lambda h: h["chulNo"]), 1, 3))]
        return F.coalesce(*found, *([by_shape(inner, False)] if deeper else []))

    return F.coalesce(by_shape(document, True), F.array().cast("array<int>"))


def leaf_paths(rows: DataFrame, key: str, document: str, depth: int = 12) -> DataFrame:
    """(key, path) of every leaf of JSON documents, array places as [].

    Each level is one explode of variants; scalars leave, containers go on. Documents with leaves
    beyond ``depth`` levels are an error, so none is lost.
    """
    of = rows.sparkSession.tvf
    level = rows.select(key, F.lit("").alias("path"), F.try_parse_json(document).alias("v"))
    leaves = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        scalars = level.filter(~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))).select(key, "path")
        leaves = scalars if leaves is None else leaves.unionByName(scalars)
        containers = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")).withColumnRenamed("v", "_v")
        inner = containers.lateralJoin(of.variant_explode(F.col("_v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        level = inner.select(containers[key], name.alias("path"), F.col("value").alias("v"))
    beyond = level.select(key, F.raise_error(F.concat(F.lit(f"deeper than {depth} levels: "), "path")).cast("string").alias("path"))
    return leaves.unionByName(beyond).distinct()


def archive(rows: DataFrame, date: str, cutoff: Column, path: str, order: list[str]) -> None:
    """Rows before the cutoff as gzipped CSV with a header, in order within and over the files (a range sort)."""
    rows.filter(F.col(date) < cutoff).orderBy(*order).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
