"""A quality classifier on random-indexing word vectors.

Words (runs of letters, digits and other non-ASCII characters; runs of marks) are told apart by
48-bit hashes. Each word has a sparse index vector derived from its hash; its context vector is the
sum of the index vectors of the words up to ``WINDOW`` places away, over all documents. These sums
are integers, added up in blocks of texts and then over a shuffle by word, so they do not depend on
how the work was divided; a block gets them back as they are, and beyond 16 bits as directions of that precision. A document's features pool its words' context vectors (mean and spread),
with the shares of distinct words and of repeats, and lengths. A two-layer network in numpy is fitted on labelled rows and its
logits are divided by a temperature fitted on rows that the weights never saw.

Bounds: every word has its own vector, and no table of words meets in one place: a task holds one
range of words or the words of one block. The network is fitted on about ``max_rows`` labelled
documents drawn by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.tables import staged

DIM, NONZERO, WINDOW = 32, 4, 2
#: Bits of a word's hash, a multiple of 8; words are dealt by this many leading ones of them at least.
WORD_BITS, PART_BITS = 48, 10
#: Magnitudes of vectors that are packed alike, and the largest number of a vector that is given back; larger vectors lose less than a float of 32 bits does in pooling.
MAGNITUDES, LARGEST = (1, 2, 3, 7, 31, 127), 32767
#: Text bytes of a block, and words of sets pooled at a time.
BLOCK_BYTES, SLICE_WORDS = 32 << 20, 100_000
#: Neighbours counted at a time.
SLICE_PAIRS = 500_000
#: Text bytes worked on at a time.
SLICE_BYTES = 1 << 19
FEATURES = 2 * DIM + 4
HIDDEN, EPOCHS, BATCH = 32, 40, 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _index_vectors(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each (words, NONZERO): the nonzero entries of each word's index vector, from its hash."""
    mixed = hashed * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    places = np.empty((len(hashed), NONZERO), dtype=np.int64)
    for j in range(NONZERO):
        place = (mixed >> np.uint64(12 * j) & np.uint64(0xFFF)).astype(np.int64) % (DIM - j)
        for taken in np.sort(places[:, :j], axis=1).T:
            place += place >= taken
        places[:, j] = place
    signs = (mixed[:, None] >> np.arange(48, 48 + NONZERO, dtype=np.uint64) & np.uint64(1)).astype(np.int64) * 2 - 1
    return places, signs


def _character_kinds() -> np.ndarray:
    kinds = np.full(256, 2, dtype=np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    for byte in range(256):
        if byte >= 128 or chr(byte).isalnum():
            kinds[byte] = 1
    return kinds


_KINDS = _character_kinds()
_powers = np.ones((2, 1), dtype=np.uint64)


def _power_rows(n: int) -> np.ndarray:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    global _powers
    powers = _powers
    if powers.shape[1] < n:
        steps = np.full((2, max(n, 2 * SLICE_BYTES)), [[_ODD], [_INVERSE]], dtype=np.uint64)
        steps[:, 0] = 1
        powers = np.multiply.accumulate(steps, axis=1)
        if n <= 2 * SLICE_BYTES:  # those of a very long text are not kept
            _powers = powers
    return powers[:, :n]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, firsts): the hash of every word of the texts, and for each text and the end its first word's number."""
    kinds = _KINDS[data]
    change = np.empty(len(data), dtype=bool)
    change[:1] = True
    change[1:] = kinds[1:] != kinds[:-1]
    change[bounds[:-1][bounds[:-1] < len(data)]] = True
    edges = np.append(np.flatnonzero(change), len(data))
    starts, ends = edges[:-1], edges[1:]
    real = kinds[starts] > 0 if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[real], ends[real]
    up, down = _power_rows(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashed = (sums[ends] - sums[starts]) * down[starts]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    return hashed >> np.uint64(64 - WORD_BITS), np.searchsorted(starts, bounds)


def _sliced(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, bounds) of runs of whole texts of about SLICE_BYTES; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        upto = min(upto, len(texts))
        yield at, upto - at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto
    pa.default_memory_pool().release_unused()


def _squeezed(raw: bytes) -> bytes:
    """Entropy-coded, as small sums and frequent word numbers have few bits each."""
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _restored(squeezed: pa.Buffer) -> bytes:
    return pa.decompress(squeezed[4:], decompressed_size=int(np.frombuffer(squeezed, np.uint32, 1)[0]), codec="zstd", asbytes=True)


def _digits(numbers: np.ndarray, largest: int) -> bytes:
    """Rows of numbers within ``largest`` of zero as bytes that hold as many of them as fit."""
    base, size = 2 * largest + 1, 1
    while base ** (size + 1) <= 256:
        size += 1
    flat = np.zeros(-(-numbers.size // size) * size, dtype=np.int64)
    flat[: numbers.size] = numbers.ravel().astype(np.int64) + largest
    return (flat.reshape(-1, size) @ base ** np.arange(size)).astype(np.uint8).tobytes()


def _from_digits(raw: bytes, n: int, largest: int) -> np.ndarray:
    base, size = 2 * largest + 1, 1
    while base ** (size + 1) <= 256:
        size += 1
    packed = np.frombuffer(raw, np.uint8).astype(np.int64)
    return ((packed[:, None] // base ** np.arange(size)) % base - largest).ravel()[: n * DIM].reshape(-1, DIM)


def _packed(vectors: np.ndarray) -> bytes:
    """Rows of integers as bytes, those of one magnitude together, as each has its own statistics."""
    most = np.abs(vectors).max(axis=1, initial=0)
    kind = np.searchsorted(MAGNITUDES, most)
    parts = [_squeezed(kind.astype(np.uint8).tobytes())]
    for k, largest in enumerate(MAGNITUDES):
        parts.append(_squeezed(_digits(vectors[kind == k], largest)))
    large = vectors[kind == len(MAGNITUDES)].astype(np.int64).ravel()
    parts.append(_squeezed(_planes((large << 1) ^ (large >> 63), 8)))  # signs last, so that high planes are empty
    return b"".join([np.array([len(p) for p in parts], np.uint32).tobytes(), *parts])


def _unpacked(packed: pa.Buffer) -> np.ndarray:
    sizes = np.frombuffer(packed, np.uint32, len(MAGNITUDES) + 2)
    ends = sizes.nbytes + np.cumsum(sizes)
    kind, *parts = (_restored(packed[int(end - size) : int(end)]) for end, size in zip(ends, sizes, strict=True))
    kind = np.frombuffer(kind, np.uint8)
    vectors = np.empty((len(kind), DIM), dtype=np.int64)
    for k, part in enumerate(parts):
        rows = kind == k
        vectors[rows] = _from_digits(part, rows.sum(), MAGNITUDES[k]) if k < len(MAGNITUDES) else _from_signed_planes(part).reshape(-1, DIM)
    return vectors


def _from_signed_planes(raw: bytes) -> np.ndarray:
    folded = _from_planes(raw, 0, len(raw) // 8, 8)
    return (folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64)


def _given_back(sums: np.ndarray) -> np.ndarray:
    """Context vectors as blocks get them: as they are in 16 bits; of larger ones the direction in 16 bits."""
    most = np.abs(sums).max(axis=1, keepdims=True, initial=0)
    return np.where(most <= LARGEST, sums, np.rint(sums * (LARGEST / np.maximum(most, 1)))).astype(np.int64)


def _planes(numbers: np.ndarray, size: int) -> bytes:
    """Numbers as byte planes, the lowest first: nearly empty planes take no room once squeezed."""
    return b"".join((numbers >> np.array(8 * k, numbers.dtype)).astype(np.uint8).tobytes() for k in range(size))


def _from_planes(raw: bytes, at: int, n: int, size: int) -> np.ndarray:
    numbers = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        numbers |= np.frombuffer(raw, np.uint8, n, at + k * n).astype(np.uint64) << np.uint64(8 * k)
    return numbers


_FEATURE_ROWS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("value", pa.list_(pa.float32()))])
BLOCKS = "dealt long, sender long, words binary, vectors binary"


def _context_sums(known: np.ndarray, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each known word the sum of the index vectors of its neighbours in these texts."""
    places, signs = (x.astype(np.int8) for x in _index_vectors(known))
    sums = np.zeros(len(known) * DIM, dtype=np.int32)
    for gap in range(1, WINDOW + 1):
        for first in range(0, len(codes) - gap, SLICE_PAIRS):
            left, right = slice(first, min(first + SLICE_PAIRS, len(codes) - gap)), slice(first + gap, min(first + SLICE_PAIRS + gap, len(codes)))
            near = owner[left] == owner[right]
            pair = codes[left][near], codes[right][near]
            for a, b in (pair, pair[::-1]):
                for j in range(NONZERO):
                    np.add.at(sums, a.astype(np.int64) * DIM + places[b, j], signs[b, j].astype(np.int32))
    return sums.reshape(-1, DIM)


def _word_sets(codes: np.ndarray, owner: np.ndarray, known: int, docs: pa.Table) -> tuple[bytes, bytes]:
    """The texts of a block as sets of words with counts, and what else is known of each text.

    Words are numbered by their frequency in the block, which is sent so that the receiver numbers
    them alike, and a text's numbers are sorted, so that their differences are small.
    """
    often = np.bincount(codes, minlength=known)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(known, dtype=np.int64)
    rank[order] = np.arange(known)
    sets, times = np.unique(owner.astype(np.int64) << 32 | rank[codes], return_counts=True)
    number = sets & 0xFFFFFFFF
    step = np.diff(number, prepend=0)
    first = np.diff(sets >> 32, prepend=-1) != 0
    step[first] = number[first]
    same = np.bincount(owner[1:], weights=(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]), minlength=len(docs))
    docs = docs.append_column("distinct", pa.array(np.bincount(sets >> 32, minlength=len(docs)))).append_column("same", pa.array(same))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as writer:
        writer.write_table(docs)
    return b"".join([np.uint32([known, len(sets)]).tobytes(), _planes(often, 4), _planes(step, 4), _planes(times, 4)]), sink.getvalue().to_pybytes()


def _block_rows(block: int, part_bits: int, hashes: list[np.ndarray], docs: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A block's own context sums, a row dealt to each range of words, and one row of its texts as sets of word numbers, dealt by the block (below zero)."""
    table = pa.Table.from_batches(docs)
    known, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    hashes.clear()
    codes = codes.astype(np.int32)
    owner = np.repeat(np.arange(len(table), dtype=np.int32), table["count"].to_numpy())
    sums = _context_sums(known, codes, owner)
    text, about = _word_sets(codes, owner, len(known), table)
    parts = (known >> np.uint64(WORD_BITS - part_bits)).astype(np.int32)
    edges = np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(parts))
    kinds = parts[edges[:-1]]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    mine = np.full(len(spans), -1 - block)
    columns = [
        pa.array([*kinds.tolist(), -1 - block], pa.int64()),
        pa.array([*mine.tolist(), 0], pa.int64()),
        pa.array([*[_squeezed(_planes(known[a:b], WORD_BITS // 8)) for a, b in spans], _squeezed(text)], pa.binary()),
        pa.array([*[_packed(sums[a:b]) for a, b in spans], _squeezed(about)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["dealt", "sender", "words", "vectors"])


def _blocker(part_bits: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of whole texts of about BLOCK_BYTES, of (doc_id, digest, text)."""
        block, size, hashes, docs = TaskContext.get().partitionId() << 24, 0, [], []
        for batch in batches:
            for at, n, data, bounds in _sliced(batch["text"]):
                hashed, firsts = words(data, bounds)
                part = batch.slice(at, n)
                columns = [part["doc_id"], part["digest"], pa.array(np.diff(firsts), pa.int64()), pa.array(np.diff(bounds), pa.int64())]
                docs.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "count", "bytes"]))
                hashes.append(hashed)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield _block_rows(block, part_bits, hashes, docs)
                    block, size, hashes, docs = block + 1, 0, [], []
        if docs:
            yield _block_rows(block, part_bits, hashes, docs)

    return blocks


def _range_words(squeezed: pa.Buffer) -> np.ndarray:
    raw = _restored(squeezed)
    return _from_planes(raw, 0, len(raw) * 8 // WORD_BITS, WORD_BITS // 8)


def _summed(rows: pa.Table) -> pa.Table:
    """The sums over all blocks of a range's words, given back to each block that has the word; texts are no ranges."""
    if rows["dealt"][0].as_py() < 0:
        return rows.slice(0, 0)
    every = [_range_words(x.as_buffer()) for x in rows["words"]]
    known, codes = np.unique(np.concatenate(every), return_inverse=True)
    sums = np.zeros((len(known), DIM), dtype=np.int64)
    at = np.cumsum([0] + [len(x) for x in every])
    mine = [codes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for one, packed in zip(mine, rows["vectors"], strict=True):
        sums[one] += _unpacked(packed.as_buffer())  # words of a row are distinct
    small = _given_back(sums)
    nothing, given = pa.array([b""] * len(mine), pa.binary()), pa.array([_packed(small[one]) for one in mine], pa.binary())
    return pa.table([rows["sender"], rows["dealt"], nothing, given], schema=rows.schema)


def _pooled_block(texts: pa.Table, given: pa.Table) -> pa.Table:
    """(doc_id, digest, features) of a block's texts, whose words' vectors have met here; the key of a range has no texts."""
    if not texts.num_rows or texts["dealt"][0].as_py() >= 0:
        return _FEATURE_ROWS.empty_table()
    text = _restored(texts["words"][0].as_buffer())
    docs = pa.ipc.open_stream(_restored(texts["vectors"][0].as_buffer())).read_all()
    given = given.sort_by("sender")  # the ranges in the order of the block's sorted hashes
    sums = (_unpacked(x.as_buffer()) for x in given["vectors"])
    vectors = np.concatenate([np.zeros((0, DIM), np.float32), *((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32) for v in sums)])
    known, entries = np.frombuffer(text, np.uint32, 2).tolist()
    often, step, times = (_from_planes(text, at, n, 4).astype(np.int64) for at, n in ((8, known), (8 + 4 * known, entries), (8 + 4 * (known + entries), entries)))
    distinct = docs["distinct"].to_numpy()
    firsts = np.append(0, np.cumsum(distinct))
    total = np.append(0, np.cumsum(step))
    number = total[1:] - np.repeat(total[firsts[:-1]], distinct)
    codes = np.argsort(-often, kind="stable")[number]
    counts, sizes, same = (docs[c].to_numpy() for c in ("count", "bytes", "same"))
    features, at = np.zeros((len(docs), FEATURES), dtype=np.float32), 0
    while at < len(docs):
        upto = min(len(docs), max(at + 1, int(np.searchsorted(firsts, firsts[at] + SLICE_WORDS, side="right")) - 1))
        own, of = slice(firsts[at], firsts[upto]), slice(at, upto)
        features[of] = pooled(vectors, codes[own], times[own], distinct[of], counts[of], sizes[of], same[of])
        at = upto
    offsets = np.arange(len(docs) + 1, dtype=np.int32) * FEATURES
    return pa.table([docs["doc_id"], docs["digest"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(features.ravel()))], schema=_FEATURE_ROWS)


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, value) for every row of ``docs``: features over the vectors of all words of ``docs``.

    A block of texts sends its words' partial sums to the words' ranges (by leading bits of the hash;
    more ranges where the session has more shuffle partitions) and gets the whole sums back; the block's texts follow as sets of word numbers.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part_bits = max(PART_BITS, (2 * partitions - 1).bit_length())
    rows = docs.select(*_key(), F.col("text").cast("string").alias("text")).mapInArrow(_blocker(part_bits), BLOCKS)
    given = rows.groupBy("dealt").applyInArrow(_summed, BLOCKS)
    return rows.groupBy("dealt").cogroup(given.groupBy("dealt")).applyInArrow(_pooled_block, "doc_id long, digest long, value array<float>")


def _key() -> list[F.Column]:
    """What tells rows of documents apart as far as their scores may differ."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col("text").cast("string")).alias("digest")]


def pooled(vectors: np.ndarray, codes: np.ndarray, times: np.ndarray, distinct: np.ndarray, counts: np.ndarray, sizes: np.ndarray, same: np.ndarray) -> np.ndarray:
    """(texts, FEATURES): word vectors pooled over whole texts; zeros for a text without words.

    ``codes`` are rows of ``vectors``, ``distinct`` of them for each text, each occurring ``times``
    in it; ``counts`` and ``sizes`` are words and bytes of a text, ``same`` its words that repeat the one before.
    """
    out = np.zeros((len(sizes), FEATURES))
    some = np.flatnonzero(distinct)
    if not len(some):
        return out
    turn = np.lexsort((codes, np.repeat(np.arange(len(distinct)), distinct)))  # the same order for equal texts of all blocks
    begins = (np.cumsum(distinct) - distinct)[some]
    size, rows, weight = counts[some][:, None], vectors[codes[turn]].astype(float), times[turn][:, None]
    mean = np.add.reduceat(rows * weight, begins, axis=0) / size
    square = np.add.reduceat(rows * rows * weight, begins, axis=0) / size
    shares = np.stack([distinct[some], same[some]], axis=1) / size
    out[some] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), shares, np.log1p(size), np.log1p(sizes[some][:, None] / size)], axis=1)
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logits."""

    middle: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.middle) / self.spread @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def fit_network(features: np.ndarray, labels: np.ndarray, seed: int = 5) -> Network:
    """A network fitted by Adam on four fifths of the rows, its temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
    n = features.shape[1]
    net = Network(
        features[used].mean(axis=0) if len(used) else np.zeros(n),
        features[used].std(axis=0) + 1e-3 if len(used) else np.ones(n),
        rng.normal(0, n**-0.5, (n, HIDDEN)),
        np.zeros(HIDDEN),
        np.zeros(HIDDEN),
        float(np.log(share / (1 - share))),
    )
    if len(np.unique(labels[used])) < 2:
        return net
    x, y = (features[used] - net.middle) / net.spread, labels[used].astype(float)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.005 * (1 - epoch / EPOCHS)
        shuffled = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = shuffled[at : at + BATCH]
            hidden = np.tanh(x[rows] @ values[0] + values[1])
            logit = hidden @ values[2] + values[3]
            error = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            back = error[:, None] * values[2] * (1 - hidden * hidden)
            slopes = [x[rows].T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ error + 1e-4 * values[2], np.array([error.sum()])]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                values[k] = values[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *values[:3], float(values[3][0])
    if len(held):
        logits, truth = net.logits(features[held]), labels[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        losses = [np.mean(np.logaddexp(0, -np.where(truth > 0, logits, -logits) / t)) for t in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
    return net


def held_out(doc_id: F.Column) -> F.Column:
    """Whether labels of this document are kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, quality): about ``max_rows`` labels at most, by a hash of their ids, none held out; one per document."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, max_rows / max(1, usable.count()))
    return usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def _scored(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, digest, score) of every row of ``docs``, by a network fitted on a bounded sample of ``labels``."""
    rows = staged(text_features(docs), "quality-features")
    sample = training_labels(labels, max_rows)
    # the sample is bounded by max_rows, so it is broadcast and its features fit on the driver
    # one row per document, whatever its repeats
    chosen = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("digest", "value")).alias("row"))
    found = chosen.select("doc_id", "quality", "row.value").toArrow().sort_by("doc_id")
    features = found["value"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if found.num_rows else np.zeros((0, FEATURES))
    net = fit_network(features.astype(float), found["quality"].to_numpy().astype(int) if found.num_rows else np.zeros(0, dtype=int))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = net.score(batch["value"].flatten().to_numpy().reshape(-1, FEATURES).astype(float))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], pa.array(value)], names=["doc_id", "digest", "score"])

    return rows.mapInArrow(score, "doc_id long, digest long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; score is the calibrated probability of quality 1.

    Only texts are inputs of a score. Null and empty texts have zero features and a score like any
    other; equal texts score equally; repeated rows stay; a null doc_id stays null; without usable
    labels (or with one class) every score is the base rate, 0.5 without labels; an empty table
    gives no rows; further columns are ignored.
    """
    return _scored(docs, labels, max_rows).select("doc_id", "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns.

    Scores are those of ``score_quality``; rows of equal doc_id and text go or stay together, rows
    without doc_id by their text; an empty table gives no rows; no column is added, and columns
    named like the two that join the scores are kept.
    """
    doc_id, digest = _key()
    named = F.coalesce(doc_id, F.lit(-1))
    kept = _scored(docs, labels, max_rows).filter(F.col("score") >= least)
    kept = kept.select(F.coalesce("doc_id", F.lit(-1)).alias("_doc"), F.col("digest").alias("_digest"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), named.alias("_doc"), digest.alias("_digest"))
    return rows.join(kept, ["_doc", "_digest"], "left_semi").select("_row.*")
