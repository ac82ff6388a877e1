"""Tables written once in the shared folder, for plans that read an intermediate result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session that names none gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark.sparkContext, "_rankfield_folder", None) or f"file://{tempfile.mkdtemp(prefix='rankfield-core-')}"
        spark.sparkContext._rankfield_folder = folder
    return folder.rstrip("/")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet and read back: later plans scan files, and a lost executor costs a read."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
