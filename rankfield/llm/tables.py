"""Reading the corpus tables and staging intermediate ones in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; a local session that names none
    (as in tests) gets one temporary folder for its lifetime. Any other session must name one,
    as a folder of one machine would lose what others write.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master})")
        folder = getattr(spark.sparkContext, "_rankfield_shared_dir", None)
        if folder is None:
            folder = f"file://{tempfile.mkdtemp(prefix='rankfield-')}"
            spark.sparkContext._rankfield_shared_dir = folder
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Later plans read the files, so their lineage is a plain scan: a lost executor costs a
    re-read, never a recomputation of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads; a table that was not staged is left alone."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
