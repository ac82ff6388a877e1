"""Packs of tables with a manifest, published at once.

A pack is written below ``.staging`` table by table; each table's row count and digest are taken
from the files and noted beside it. When all are there, the manifest is written, the folder
moves to its version's name, which follows from the digests, and last the pointer ``CURRENT`` is
replaced by a rename. Readers follow the pointer, so what a killed run leaves is never read; a run
of the same name goes on with the tables that are complete.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_of(records: DataFrame, key: list[str], time: str, reference: Column) -> DataFrame:
    """The last version of each key at or before ``reference``; of equal times the greatest row.

    One aggregation with partial sums, no window: a key with very many versions is reduced before
    the shuffle. Versions without a time, and keys first seen later, are left out.
    """
    rest = [c for c in records.columns if c not in key]
    known = records.filter(F.col(time) <= reference)
    last = known.groupBy(*key).agg(F.max(F.struct(F.col(time).alias("_time"), *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in records.columns])


def row_digest(rows: DataFrame) -> Column:
    """The sum over all rows of 48 bits of MD5 of the row as text: the same in any order, another one if any value differs."""
    atomic = lambda f: not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    said = [F.coalesce((F.col(f.name) if atomic(f) else F.to_json(F.col(f.name))).cast("string"), F.lit("~")) for f in rows.schema.fields]
    word = F.conv(F.substring(F.md5(F.concat_ws("|", *said).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return F.coalesce(F.sum(word), F.lit(0)).cast("string")


class Folder:
    """Files of the folder's own store, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.files.exists(self._path(name))

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def write(self, name: str, text: str) -> None:
        out = self.files.create(self._path(name), True)
        out.write(text.encode())
        out.close()

    def move(self, name: str, to: str) -> None:
        """Rename; the last step of a write, as it happens at once or not at all."""
        self.files.mkdirs(self._path(to).getParent())
        if not self.files.rename(self._path(name), self._path(to)):
            raise OSError(f"cannot move {self.path}/{name} to {to}")

    def replace(self, name: str, to: str) -> None:
        """Rename over a file that may exist."""
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(name), self._path(to), options)

    def delete(self, name: str) -> None:
        self.files.delete(self._path(name), True)


def _written(table: DataFrame, path: str) -> dict:
    """Write a table; its count and digest are those of the rows that the files hold."""
    table.write.mode("overwrite").parquet(path)
    held = table.sparkSession.read.schema(table.schema).parquet(path)
    seen = held.agg(F.count(F.lit(1)).alias("rows"), row_digest(held).alias("digest")).first()
    return {"rows": seen["rows"], "digest": seen["digest"], "schema": table.schema.jsonValue()}


def write_pack(tables: dict[str, DataFrame], target: str, info: dict[str, str], run: str) -> str:
    """Write and publish a pack; gives its version. ``run`` names the attempt that may be taken up again.

    Equal tables and info make the same version, whoever writes them; writing it again changes nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, staging = Folder(spark, target), f".staging/{run}"
    found = {}
    for name, table in tables.items():
        note = f"{staging}/{name}.json"
        if not folder.exists(note):
            written = _written(table, f"{folder.path}/{staging}/{name}")
            folder.write(note, json.dumps(written, sort_keys=True))
        found[name] = json.loads(folder.read(note))
    body = {"info": info, "tables": found}
    version = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]
    if folder.exists(f"packs/{version}/manifest.json"):
        folder.delete(staging)
    else:
        folder.write(f"{staging}/manifest.json", json.dumps(body | {"version": version}, sort_keys=True))
        folder.move(staging, f"packs/{version}")
    folder.write(f".staging/CURRENT-{run}", version)
    folder.replace(f".staging/CURRENT-{run}", "CURRENT")
    return version


@dataclass
class Pack:
    manifest: dict
    tables: dict[str, DataFrame]


def read_pack(spark: SparkSession, target: str, version: str | None = None, check: bool = True) -> Pack:
    """The published pack, or one of its versions; with ``check`` every table is counted and digested again.

    A missing pointer or version is an error, and so are rows that differ from the manifest's.
    """
    folder = Folder(spark, target)
    if version is None:
        if not folder.exists("CURRENT"):
            raise FileNotFoundError(f"{target} has no published pack")
        version = folder.read("CURRENT").strip()
    if not folder.exists(f"packs/{version}/manifest.json"):
        raise FileNotFoundError(f"{target} has no version {version}")
    manifest = json.loads(folder.read(f"packs/{version}/manifest.json"))
    tables = {name: spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(f"{folder.path}/packs/{version}/{name}") for name, t in manifest["tables"].items()}
    if check:
        for row in verified(manifest, tables).collect():  # a row for each table
            if not row["same"]:
                raise ValueError(f"{row['name']} of {target}/{version} differs from its manifest")
    return Pack(manifest, tables)


def verified(manifest: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest, same): what the tables hold, and whether the manifest says so."""
    parts = []
    for name, table in tables.items():
        noted = manifest["tables"][name]
        now = table.agg(F.count(F.lit(1)).alias("rows"), row_digest(table).alias("digest"))
        parts.append(now.select(F.lit(name).alias("name"), "rows", "digest", ((F.col("rows") == noted["rows"]) & (F.col("digest") == noted["digest"])).alias("same")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
