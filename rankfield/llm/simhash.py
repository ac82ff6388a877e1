"""SimHash near-duplicate detection over an inverted index of positional bytes.

A fingerprint has 64 bits in eight bytes. Two fingerprints that differ in at most three bits
differ in at most three bytes, so they share at least five of the eight positional bytes. Any
five of eight positions hold three positions of the same half (the upper or the lower four
bytes), so an index keyed by the three-byte subsets of each half, eight keys a fingerprint,
brings every linked pair together at least once. Inside a posting the shared positional bytes
are tallied per pair, pairs that reach the guaranteed minimum stay and are verified bit by bit.

Scale: equal fingerprints collapse to one row before the index is built, so the size of a group
of copies never matters. A posting emits a spanning forest of its verified links (fewer edges
than rows), not all its pairs. Postings beyond ``HOT_POSTING`` rows are split by two further
shared bytes: a linked pair shares at least two of the five remaining positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.tables import discard, staged

#: Fingerprints at no more than this many differing bits are linked; the subsets below rest on it.
MAX_BITS = 3
#: Eight positional bytes less one for each differing bit.
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Words in a shingle.
SHINGLE_WORDS = 3
#: Seed of the XXH64 shingle hash.
HASH_SEED = 42
#: Rows of a posting beyond which it is split by two more bytes.
HOT_POSTING = 4096


def fingerprint_bytes(text: str | None) -> bytes:
    """The eight fingerprint bytes of one text, most significant first.

    Words are the runs between ASCII white space after A-Z are lower-cased. A text with fewer
    than three words is one shingle; one without words (null and empty texts) has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    parts = [words[i:] for i in range(SHINGLE_WORDS)] if len(words) >= SHINGLE_WORDS else [[word] for word in words]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(b" ".join(shingle), HASH_SEED) for shingle in zip(*parts, strict=False)])
    n = len(hashes) // 8
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8 << 16):
        bits = np.unpackbits(np.frombuffer(hashes[at : at + (8 << 16)], dtype=np.uint8))
        # 255 rows of 0/1 bytes can be added in eight lanes of 64 bits without a carry
        lanes = bits.view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = b"".join(fingerprint_bytes(text.as_py()) for text in batch.column(1))
        values = np.frombuffer(found, dtype=">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every whole text; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprint_batches, "doc_id long, fp long"
    )


def _postings(classes: DataFrame) -> DataFrame:
    """One row per distinct fingerprint and three-byte subset of a half."""
    keys = []
    for half in range(2):
        word = F.shiftrightunsigned("fp", 32) if half == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        for left_out in range(4):
            kept = 0xFFFFFFFF & ~(0xFF << 8 * left_out)
            keys.append(word.bitwiseAND(F.lit(kept)) + F.lit((4 * half + left_out) << 32))
    return classes.select("fp", "node", F.explode(F.array(*keys)).alias("key"))


def _split_keys() -> F.Column:
    """For a posting key: the two-byte subsets of the five positions that the key leaves open."""
    slots = F.lit(None)
    for slot in range(8):
        half, left_out = divmod(slot, 4)
        # byte shifts from the right: the key holds three bytes of one half, the other half is open
        open_bytes = [*range(4 * half, 4 * half + 4), 4 * (1 - half) + left_out]
        subs = []
        for n, (a, b) in enumerate(combinations(open_bytes, 2)):
            byte = [F.shiftrightunsigned("fp", 8 * x).bitwiseAND(F.lit(0xFF)) for x in (a, b)]
            subs.append(F.lit(n << 16) + byte[0] * 256 + byte[1])
        slots = F.when(F.shiftright("key", 32) == slot, F.array(*subs)).otherwise(slots)
    return slots


def _forest(fp: np.ndarray, node: np.ndarray, run: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of rows whose fingerprints are within MAX_BITS, inside runs of equal ``run``."""
    parent = np.arange(len(fp))
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    left = np.arange(len(fp))
    step = 0
    while True:
        step += 1
        left = left[left + step < len(fp)]
        left = left[run[left] == run[left + step]]
        if not len(left):
            return links
        ask = left[parent[left] != parent[left + step]]
        differ = fp[ask] ^ fp[ask + step]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        ask, differ = ask[shared >= MIN_SHARED_BYTES], differ[shared >= MIN_SHARED_BYTES]
        joined = False
        for i in ask[np.bitwise_count(differ) <= MAX_BITS].tolist():
            a, b = root(i), root(i + step)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(node[i]), int(node[i + step])))
                joined = True
        while joined:  # flatten, so that equal parents mean joined rows
            above = parent[parent]
            joined = bool((above != parent).any())
            parent = above


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (key, sub); a run that spans batches is held until it ends."""
    held: list[pa.RecordBatch] = []

    def emit(rows: list[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(rows).slice(0, n)
        key, sub, fp, node = (data[c].to_numpy() for c in ("key", "sub", "fp", "node"))
        if not len(key):
            return
        run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))])
        links = _forest(np.ascontiguousarray(fp).view(np.uint64), node, run)
        if links:
            a, b = (pa.array(x, pa.int64()) for x in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key, sub = batch["key"].to_numpy(), batch["sub"].to_numpy()
        last = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
        if len(last):  # all runs before the last one are whole
            before = sum(x.num_rows for x in held[:-1])
            whole = before + int(last[-1]) + 1
            yield from emit(held, whole)
            held = [batch.slice(int(last[-1]) + 1)]
    if held:
        yield from emit(held, sum(x.num_rows for x in held))


def _classes(fps: DataFrame) -> DataFrame:
    """One row per distinct fingerprint with its node, the smallest doc_id that has it."""
    return fps.groupBy("fp").agg(F.min("doc_id").alias("node"))


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the nodes connected by pairs within MAX_BITS."""
    postings = _postings(classes.filter(F.col("node").isNotNull()))
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = postings.join(sizes, "key")
    cold = F.array(F.lit(-1).cast("long"))
    keyed = shared.select(
        "key", F.explode(F.when(F.col("rows") > HOT_POSTING, _split_keys()).otherwise(cold)).alias("sub"), "fp", "node"
    )
    return keyed.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp").mapInArrow(_link_batches, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps; each round is written to the shared folder, and
    only its row count and checksum come to the driver. Groups are reduced to their minimum
    before the shuffle, so a hub with very many neighbours is never gathered.
    """
    edges = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(state)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, staged(small.union(least).distinct(), "edges")
        discard(before, large)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most MAX_BITS differing bits,
    the document's own included. Null and empty texts have fingerprint zero and link like any
    other; repeated rows keep one output row each; a row without doc_id takes the component of
    its fingerprint and gives it no name (null if nothing named shares that fingerprint). An
    empty table gives no rows; further columns of ``docs`` are ignored.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    classes = staged(_classes(fps), "classes")
    labels = connected_components(links(classes))
    named = classes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(staged(named, "named"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` left when one document of each near-duplicate group stays.

    The smallest doc_id of a group stays, with all its columns; repeated rows of that doc_id
    count as copies, and any one of them stays. Rows without doc_id cannot be told apart by name
    and stay. Null and empty texts are one group; an empty table gives no rows; no column is
    added, so none can clash.
    """
    kept = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.filter(F.col("doc_id").isNull()))
