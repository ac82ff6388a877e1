"""A corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's documents. All but the last return the columns of documents, whatever
these are; an empty table stays empty; rows without doc_id and repeated rows pass as stated below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankfield.llm import mixing, packing, quality, secret_scan, simhash
from rankfield.llm.queries import CAPACITY
from rankfield.llm.tables import staged, table

#: Documents scored below this are rejected; even odds, so that clean documents stay where a score is uncertain (figures in the README).
LEAST_SCORE = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored like any other, equal rows go or stay together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), LEAST_SCORE)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each near-duplicate group; null and empty texts are one group, rows without doc_id stay."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and n_chars counted anew; null texts and texts without secrets stay as they are."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to equal source shares and shuffled; copies repeat their row, null sources are one source, rows drawn 0 times go."""
    return mixing.mix(docs).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; null and empty texts are one piece of one token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_one),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_documents),
]

#: Tokenizing and fitting are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
