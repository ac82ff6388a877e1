"""Field policies: which columns a consumer may read, and scans for forbidden ones.

Rules are configuration. Paths of a table's schema are resolved on the driver into a list of
columns; paths of open documents are rows and are joined with the rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
ALLOWED = ("ALLOW", "ALLOW_SNAPSHOT_ONLY", "ALLOW_STORED_ONLY")
MOST_RULES = 100_000
OPTIONAL = {"hold": "HOLD", "label": "LABEL_ONLY", "meta": "META_ONLY"}


@dataclass(frozen=True)
class Rule:
    """A path (exact, or a prefix with a trailing .*) and its flag."""

    path: str
    flag: str


def flag_of(path: str, rules: list[Rule], forbidden: str) -> str:
    """The flag of a path: the exact rule, else the longest prefix rule, else BLOCK for forbidden leaves, else ALLOW."""
    path = re.sub(r"\[\d*\]", "[]", path)
    exact = {r.path: r.flag for r in rules}
    if path in exact:
        return exact[path]
    prefixes = [r for r in rules if r.path.endswith(".*") and path.startswith(r.path[:-1])]
    if prefixes:
        return max(prefixes, key=lambda r: len(r.path)).flag
    return "BLOCK" if re.search(forbidden, path.rsplit(".", 1)[-1]) else "ALLOW"


def is_allowed(flag: str, *options: str) -> bool:
    """Whether a flag may be read, with opt-ins hold, label, meta."""
    return flag in ALLOWED or flag in {OPTIONAL[o] for o in options}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema; array elements as []."""
    found = []
    for field in schema.fields:
        path, kind = f"{prefix}{field.name}", field.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        found += schema_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return found


def pruned(column: Column, kind: T.DataType, path: str, keep) -> Column | None:
    """``column`` with the leaves for which ``keep(path)`` holds, nested ones included; null where nothing is left."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, pruned(column[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, keep)) for f in kind.fields]
        parts = [c.alias(n) for n, c in parts if c is not None]
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        probe = pruned(column[0], kind.elementType, f"{path}[]", keep)
        return F.transform(column, lambda x: pruned(x, kind.elementType, f"{path}[]", keep)) if probe is not None else None
    return column if keep(f"{path}[]" if isinstance(kind, T.ArrayType) else path) else None


def filter_columns(rows: DataFrame, rules: list[Rule], forbidden: str, *options: str) -> DataFrame:
    """``rows`` with the allowed leaves only; a projection, so scans read nothing else."""
    keep = lambda path: is_allowed(flag_of(path, rules, forbidden), *options)
    columns = [(f.name, pruned(F.col(f.name), f.dataType, f.name, keep)) for f in rows.schema.fields]
    return rows.select(*[c.alias(n) for n, c in columns if c is not None])


def policy_report(rows: DataFrame, rules: list[Rule], forbidden: str) -> DataFrame:
    """(flag, fields) over the schema of ``rows``."""
    paths = [(flag_of(p, rules, forbidden), p) for p in schema_paths(rows.schema)]
    return rows.sparkSession.createDataFrame(paths, "flag string, path string").groupBy("flag").agg(F.array_sort(F.collect_list("path")).alias("fields"))


def tagged_paths(paths: DataFrame, contract: DataFrame, default: str) -> DataFrame:
    """``paths`` (..., path) with ``tag`` from a contract (path, tag); unknown ones get the default. A contract of at most MOST_RULES rows is broadcast."""
    plain = F.regexp_replace("path", r"\[\d*\]", "[]")
    rules = contract.withColumnRenamed("path", "_plain")
    rules = F.broadcast(rules) if contract.count() <= MOST_RULES else rules
    joined = paths.withColumn("_plain", plain).join(rules, "_plain", "left")
    return joined.withColumn("tag", F.coalesce("tag", F.lit(default))).drop("_plain")


def ownership_violations(features: DataFrame, contract: DataFrame) -> DataFrame:
    """(feature, owners) of features that the contract does not own exactly once with an allowed flag."""
    owned = contract.filter(F.col("flag").isin(*ALLOWED)).groupBy("feature").agg(F.count(F.lit(1)).alias("owners"))
    return features.join(owned, "feature", "left").select("feature", F.coalesce("owners", F.lit(0)).alias("owners")).filter("owners <> 1")
