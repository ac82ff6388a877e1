"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in a folder that all
executors share. Content is normalised as the count sees it (null text becomes the empty text;
nothing else may change, since every other rewriting can change a count) and digested with
SHA-256; the tokenizer digest covers its file and the library's version.

Texts never move. A first scan writes narrow rows: document, size, digest, and where the text lies
(file and row). Digests without a stored count are found by a join of narrow rows, one row of each
is picked, and the picked rows become a bitmap for each file. A second scan encodes the rows whose
bit is set, in place, and appends their counts to the cache. Then the narrow rows join the stored
counts of their digests. A second run over the same texts encodes nothing and reads no text twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.llm.memo import opened, version_digest
from rankfield.llm.tables import discard, staged

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Rows whose bitmaps are broadcast at a time: one bit each, so 64 MB at most.
WAVE_ROWS = 1 << 29


def stored_counts(spark: SparkSession, cache_path: str, tokenizer_digest: str) -> DataFrame:
    """(content_digest, n_tokens) of one tokenizer version, one row per digest.

    Two jobs that append at once may store a digest twice, with equal counts; that does no harm.
    """
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == tokenizer_digest)
    return cache.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoder(tokenizer_path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = opened(tokenizer_path, spaces_matter=True)
        for batch in batches:
            for at, _, ends in memo.encode(batch.column(1)):
                counts = np.diff(ends, prepend=0)
                names = ["content_digest", "tokenizer_digest", "n_tokens"]
                columns = [batch.column(0).slice(at, len(counts)), pa.array([version] * len(counts)), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return encode


def _located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, content_digest, file, row) of every row; null texts are empty.

    Rows that do not come straight from Parquet files are written to the shared folder first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def placed(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.select(
            F.col("doc_id").cast("long"),
            text.alias("text"),
            F.unhex(F.sha2(text, 256)).alias("content_digest"),
            F.xxhash64(place["file_path"]).alias("file"),
            place["row_index"].alias("row"),
        )

    try:
        return placed(docs)
    except AnalysisException:
        return placed(staged(docs.select("doc_id", "text"), "texts"))


def _bitmaps(rows: DataFrame) -> DataFrame:
    """(file, words): a bitmap of the rows of each file, in words of 64 bits.

    Files whose names hash alike share one, so that at worst a row too many is encoded.
    """
    words = rows.groupBy("file", F.expr("cast(row div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row % 64 as int))")).alias("bits"))
    filled = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    made = words.groupBy("file").agg(filled.alias("at"), F.max("word").alias("last"))
    return made.select("file", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.col("at")[i], F.lit(0).cast("long"))).alias("words"))


def _encode_missing(located: DataFrame, missing: DataFrame, rows: int, tokenizer_path: str, version: str, cache_path: str) -> None:
    """Encode the texts at the places in ``missing`` where they lie and append their counts to the cache."""
    waves = -(-rows // WAVE_ROWS)
    for wave in range(waves):
        mine = F.pmod("file", F.lit(waves)) == wave
        bitmaps = F.broadcast(_bitmaps(missing.filter(mine)))  # one bit a row of at most about WAVE_ROWS rows
        marked = F.expr("shiftrightunsigned(get(words, cast(row div 64 as int)), cast(row % 64 as int)) & 1L = 1L")
        texts = located.filter(mine).join(bitmaps, "file").filter(marked).select("content_digest", "text")
        texts.mapInArrow(_encoder(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``, whole texts, specials handled as the library does by default.

    Runs the encoding of misses and their append to ``cache_path`` when called. Null and empty
    texts have 0 bytes and 0 tokens; repeated rows and ties keep one output row each; a null
    doc_id stays null; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)  # makes a new cache readable
    located = _located(docs)
    narrow = staged(located.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest", "file", "row"), "digests")

    distinct = narrow.groupBy("content_digest").agg(F.min(F.struct("file", "row")).alias("place"))
    missing = staged(distinct.join(stored_counts(spark, cache_path, version), "content_digest", "left_anti").select("place.*"), "missing")
    if not missing.isEmpty():
        _encode_missing(located, missing, narrow.count(), tokenizer_path, version, cache_path)

    discard(missing)

    # Both sides of the last join are plain tables, so that a digest with very many rows is split at run time.
    wanted = narrow.select("content_digest").distinct()
    counts = staged(stored_counts(spark, cache_path, version).join(wanted, "content_digest", "left_semi"), "counts")
    return narrow.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")
