"""Streaming forms of the event operators. Each takes a streaming or a batch DataFrame of (ts, ...) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files as they arrive; ts becomes a timestamp with zone for watermarks."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, keys: list[str], length: str, late: str) -> DataFrame:
    """Counts and sums per key and window; rows later than ``late`` behind the newest are dropped."""
    window = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, keys: list[str], length: str, slide: str, late: str) -> DataFrame:
    """As tumbling, over overlapping windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


def without_repeats(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def before_cutoff(events: DataFrame, cutoffs: DataFrame, key: str) -> DataFrame:
    """Stream-static join: rows no later than their key's cutoff."""
    return events.join(cutoffs, key).filter(F.col("ts") <= F.col("cutoff"))


LATEST = "key long, event_id long, ts timestamp, value double"


def latest_by_key(events: DataFrame, key: str, late: str, idle: str = "365 days") -> DataFrame:
    """The newest row of each key after every micro-batch that changed it; keys idle for long (in event time) lose their state.

    A late row never replaces a newer one. State is one row per live key.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        seen = best
        for batch in batches:
            row = batch.sort_values(["ts", "event_id"]).iloc[-1]
            mine = (int(row["event_id"]), row["ts"].to_pydatetime(), float(row["value"]) if pd.notna(row["value"]) else None)
            if seen is None or (mine[1], mine[0]) > (seen[1], seen[0]):
                seen = mine
        state.update(seen)
        newest = max(int(pd.Timestamp(seen[1]).timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(newest + int(pd.Timedelta(idle).total_seconds() * 1000))
        if seen != best:
            yield pd.DataFrame([(int(group[0]), *seen)], columns=["key", "event_id", "ts", "value"])

    rows = events.withWatermark("ts", late).select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long"), "ts", F.col("value").cast("double"))
    return rows.groupBy("key").applyInPandasWithState(update, LATEST, "event_id long, ts timestamp, value double", "update", GroupStateTimeout.EventTimeTimeout)
