"""Balanced contiguous shards from global byte prefix sums.

Rows are put into one global order in which equal texts stand together: groups of equal texts by
descending magnitude of their bytes, then by a bucket of their digest, then by digest. A group's
place is found from prefix sums at three levels (magnitudes, buckets in a magnitude, groups in a
bucket), each level from the totals of the level below, so no window holds more than one bucket.
The order is cut at equal byte targets: a group goes where its middle falls. Groups that alone
reach a shard's share get a shard of their own and the rest is cut equally over the others. Equal
texts always share a shard. Inside a group rows are numbered over cells of a hash of their id, so
a group of copies of any size is spread over many tasks. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.tables import staged

#: Buckets of each magnitude.
BUCKETS = 1024
#: Cells over which the rows of one group are numbered.
CELLS = 256
#: What tells texts apart: two independent checksums and the size.
GROUP = ["key", "crc", "size"]


def _before(total: str, *keys: str, order: list[str]) -> F.Column:
    """The sum of ``total`` over what stands before a row in its group of ``keys``; ``order`` is unique there."""
    return F.sum(total).over(Window.partitionBy(*keys).orderBy(*order)) - F.col(total)


def _placed_groups(groups: DataFrame, giant_bytes: int) -> DataFrame:
    """``groups`` (key, crc, text_bytes, bytes, rows) with bytes_before and rows_before in the global order."""
    giant = F.col("bytes") >= giant_bytes
    groups = groups.select(
        "*",
        F.when(giant, -64).otherwise(-F.floor(F.log2("bytes"))).cast("int").alias("level"),
        F.pmod("key", F.lit(BUCKETS)).alias("bucket"),
    )
    buckets = groups.groupBy("level", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    levels = buckets.groupBy("level").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    over_levels = Window.orderBy("level")  # one row per power of two: 64 at most
    levels = levels.select(
        "level",
        (F.sum("bytes").over(over_levels) - F.col("bytes")).alias("level_bytes"),
        (F.sum("rows").over(over_levels) - F.col("rows")).alias("level_rows"),
    )
    buckets = buckets.select(
        "level",
        "bucket",
        _before("bytes", "level", order=["bucket"]).alias("bucket_bytes"),
        _before("rows", "level", order=["bucket"]).alias("bucket_rows"),
    ).join(F.broadcast(levels), "level")
    inner = groups.select(
        "*",
        _before("bytes", "level", "bucket", order=GROUP).alias("in_bytes"),
        _before("rows", "level", "bucket", order=GROUP).alias("in_rows"),
    )
    return inner.join(buckets, ["level", "bucket"]).select(
        *GROUP,
        "bytes",
        giant.alias("giant"),
        (F.col("level_bytes") + F.col("bucket_bytes") + F.col("in_bytes")).alias("bytes_before"),
        (F.col("level_rows") + F.col("bucket_rows") + F.col("in_rows")).alias("rows_before"),
    )


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    size is the UTF-8 bytes of the text plus 1; null and empty texts have size 1, CRC 0 and form
    one group. Ties and repeated rows each take a slot of their own; a null doc_id stays null; an
    empty table gives no rows; further columns are ignored. With fewer groups than shards some
    shards stay empty. The narrow rows are staged in the shared folder; four numbers (the total,
    and the count and bytes of groups of a whole share) come to the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int").alias("cell"),
    )
    rows = staged(rows, "sized")
    cells = rows.groupBy(*GROUP, "cell").agg(F.sum("size").alias("cell_bytes"), F.count(F.lit(1)).alias("cell_rows"))
    groups = cells.groupBy(*GROUP).agg(F.sum("cell_bytes").alias("bytes"), F.sum("cell_rows").alias("rows"))

    total = rows.agg(F.sum("size")).first()[0] or 0
    giant_bytes = max(1, -(-total // shards))
    found = groups.filter(F.col("bytes") >= giant_bytes).agg(F.count(F.lit(1)), F.sum("bytes")).first()
    giants, taken = found[0], found[1] or 0

    placed = staged(_placed_groups(groups, giant_bytes), "placed")
    # no more groups than shards can reach a share each, so this window is a few rows
    alone = placed.filter("giant").withColumn("shard", (F.row_number().over(Window.orderBy("rows_before")) - 1).cast("int"))
    rest = max(1, 2 * (total - taken))
    at = F.expr(f"({shards - giants}L * (2 * (bytes_before - {taken}L) + bytes)) div {rest}L")
    spread = placed.filter("not giant").withColumn("shard", (F.lit(giants) + at).cast("int"))
    sharded = alone.unionByName(spread)
    starts = sharded.groupBy("shard").agg(F.min("rows_before").alias("shard_start"))  # one row per shard
    sharded = sharded.join(F.broadcast(starts), "shard").select(*GROUP, "shard", (F.col("rows_before") - F.col("shard_start")).alias("group_slot"))

    numbered = cells.select(*GROUP, "cell", _before("cell_rows", *GROUP, order=["cell"]).alias("cell_slot")).join(sharded, GROUP)
    in_cell = F.row_number().over(Window.partitionBy(*GROUP, "cell").orderBy("doc_id")) - 1
    return rows.join(numbered, [*GROUP, "cell"]).select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("group_slot") + F.col("cell_slot") + in_cell).cast("long").alias("slot"),
    )
