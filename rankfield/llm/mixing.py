"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its share of the target bytes over its bytes in the
corpus. A document's count is drawn by inverting the Poisson distribution at a uniform number
hashed from its id (its text where it has none) and a seed, so it depends on nothing but these and
the rate, and a lost task draws the same again. Copies are exploded and shuffled globally by a hash
of (id or text, copy, seed): rows are dealt by that key and their text and sorted in each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.tables import staged

#: Up to so many sources the rates (a name and a few numbers each) are broadcast; beyond, joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A larger mean is drawn as a sum of equal independent parts no larger than this.
PART_MEAN = 64


def uniform(*keys: F.Column) -> F.Column:
    """A number in [0, 1) with 52 bits from MD5 of the keys; null keys count as the word null."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """(source, rate): the mean number of copies of each document of a source.

    Sizes are UTF-8 bytes plus 1. ``weights`` None: every source weighs the same. Otherwise a
    source without a weight has rate 0, and a weight without documents is left out of the shares.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + F.lit(1)
    sizes = docs.groupBy("source").agg(F.sum(size).alias("bytes"))
    weight = F.lit(1.0)
    if weights is not None:
        pairs = [F.lit(x) for item in weights.items() for x in item]
        weight = F.coalesce(F.create_map(*pairs)[F.coalesce("source", F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("weight", weight.cast("double"))
    whole = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight")).first()
    share = F.lit(float(epochs)) * F.lit(float(whole["all_bytes"] or 0)) / F.lit(float(whole["all_weight"] or 1))
    return sizes.select("source", (F.col("weight") * share / F.col("bytes")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, rate, parts, steps): the Poisson distribution function of mean rate / parts at 0, 1, 2, ...

    ``steps`` goes ten deviations and twenty beyond the mean, where the rest is below 2^-52, and
    has fewer than 200 entries.
    """
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    known = rates.filter("rate > 0").withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 20).cast("int")
    by_k = known.select("*", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k")
    by_k = by_k.withColumn("log_factorial", F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(upto))
    term = F.exp(F.col("k") * F.log("mean") - F.col("mean") - F.col("log_factorial"))
    by_k = by_k.withColumn("step", F.sum(term).over(upto))
    return by_k.groupBy("source", "rate", "parts").agg(F.array_sort(F.collect_list("step")).alias("steps"))


def _new_names(taken: list[str], n: int) -> list[str]:
    """``n`` column names that differ from the taken ones."""
    longest = max((len(c) for c in taken), default=0)
    return [f"mix_{'_' * longest}{i}" for i in range(n)]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """The columns of ``docs`` with ``copy`` (from 1), ``rate`` and ``shuffle_key``, in shuffled order.

    Over the output each source has its weight's share of ``epochs`` times the corpus's bytes, in
    expectation. Null sources form one source (weight of "" if weights are given); null and empty
    texts have size 1; documents drawn 0 times are not in the output, by design; rows of equal
    doc_id (without one, of equal text) draw the same count; an empty table gives no rows; columns of ``docs`` named like the
    three new ones are replaced.
    """
    own = [c for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    tables = staged(poisson_tables(source_rates(docs, weights, epochs)), "rates")
    law, source, drawn_copies = _new_names(own, 3)
    tables = tables.select(F.struct("rate", "parts", "steps").alias(law), F.col("source").alias(source))
    if tables.count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    joined = docs.select(*own).join(tables, F.col("source").eqNullSafe(F.col(source)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col(f"{law}.parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter(f"{law}.steps", lambda step: step <= uniform(name, part, F.lit(seed)))),
    )
    drawn = joined.withColumn(drawn_copies, draws).filter(F.col(drawn_copies) > 0)
    copies = drawn.select(*own, F.explode(F.sequence(F.lit(1), F.col(drawn_copies))).alias("copy"), F.col(f"{law}.rate").alias("rate"))
    keyed = copies.withColumn("shuffle_key", uniform(name, F.col("copy"), F.lit(seed), F.lit("order")))
    return keyed.repartition("shuffle_key", F.xxhash64(F.col("text").cast("string"))).sortWithinPartitions("shuffle_key", "doc_id", "copy")
