"""Best-fit packing with length patterns fitted by non-negative least squares.

1. Every text is tokenized where it lies and cut into pieces of at most ``capacity`` tokens; only
   narrow rows (ids of document and piece, start, length, checksum) go on.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) comes to the
   driver. Patterns of one to three lengths that fill a sequence exactly are enumerated, their
   repeat counts fitted to the histogram by active-set non-negative least squares and rounded, and
   what they leave over (mostly short documents) is packed by best fit decreasing, in bulk on the
   histogram. The plan's size depends on ``capacity`` alone.
3. Pieces of one length are ranked by a two-level prefix count (cells of a hash of the document,
   then rows in a cell), so no length, however frequent, meets in one task. A piece's rank picks
   its pattern, its sequence and its offset by binary search in the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.memo import opened
from rankfield.llm.tables import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(tokenizer_path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = opened(tokenizer_path, spaces_matter=False)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, ids, ends in memo.encode(batch.column(1)):
                rows = []
                begin = 0
                for name, end in zip(names[at : at + len(ends)], ends.tolist(), strict=True):
                    whole = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        rows.append((name, n, start, len(part), zlib.crc32(part)))
                    begin = end
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids, then ``end_id``, cut only where longer than ``capacity``."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(_cutter(tokenizer_path, capacity, end_id), PIECES)


def exact_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, descending and padded with 0, that sum to ``capacity`` and occur in ``present`` (a mask by length)."""
    lengths = np.flatnonzero(present)
    found = [np.array([[capacity, 0, 0]])] if present[capacity] else []
    twice = lengths[(lengths >= capacity - lengths) & (lengths < capacity)]
    twice = twice[present[capacity - twice]]
    found.append(np.stack([twice, capacity - twice, np.zeros_like(twice)], axis=1))
    for first in lengths[lengths < capacity]:
        second = lengths[(lengths <= first) & (lengths < capacity - first) & (2 * lengths >= capacity - first)]
        second = second[present[capacity - first - second]]
        found.append(np.stack([np.full_like(second, first), second, capacity - first - second], axis=1))
    return np.concatenate(found)


def _without_shared_lengths(patterns: np.ndarray, gain: np.ndarray, turns: int = 4) -> np.ndarray:
    """Numbers of patterns of high gain of which no two hold the same length."""
    order, chosen = np.argsort(-gain, kind="stable"), []
    taken = np.zeros(int(patterns.max()) + 1, dtype=bool)
    for _ in range(turns):
        rows = patterns[order]
        order = order[~taken[rows].any(axis=1)]
        if not len(order):
            break
        rows, here = patterns[order], np.arange(len(order))
        first = np.full(len(taken), len(order))
        for column in rows.T:
            np.minimum.at(first, column, here)
        wins = ((first[rows] == here[:, None]) | (rows == 0)).all(axis=1)
        chosen.append(order[wins])
        taken[rows[wins]] = True
        taken[0] = False
        order = order[~wins]
    return np.concatenate(chosen)


def _made(patterns: np.ndarray, repeats: np.ndarray, n: int) -> np.ndarray:
    """The histogram of so many repeats of the patterns; index 0 counts padding."""
    return np.bincount(patterns.ravel(), weights=np.repeat(repeats, 3), minlength=n)


def _least_squares(patterns: np.ndarray, histogram: np.ndarray, weight: np.ndarray, x: np.ndarray, steps: int = 60) -> np.ndarray:
    """Repeats of either sign that fit best, by conjugate gradients from ``x``."""

    def slope(gap: np.ndarray) -> np.ndarray:
        return (weight * gap)[patterns].sum(axis=1)

    rest = slope(histogram - _made(patterns, x, len(histogram)))
    way, size = rest, rest @ rest
    enough = 1e-12 * size
    for _ in range(steps):
        if size <= enough:
            break
        bent = slope(_made(patterns, way, len(histogram)))
        length = size / max(way @ bent, 1e-300)
        x, rest = x + length * way, rest - length * bent
        new = rest @ rest
        way, size = rest + new / size * way, new
    return x


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 24, entering: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of patterns, their repeats > 0) that make the histogram in non-negative least squares.

    An active-set method: in each round the patterns of steepest slope that share no length enter,
    the active ones are fitted without a sign, and where some become negative the step ends at the
    first zero and they leave. So few patterns a length are used and their repeats are large.
    An error counts relative to the length's count and in proportion to the length, as long
    documents are the hardest to place. Length 0 is padding and takes no part.
    """
    weight = np.zeros(len(histogram))
    weight[1:] = np.arange(1, len(histogram)) / np.maximum(histogram[1:], 1)
    least = 1e-3 * (weight * histogram).max()
    columns = np.ascontiguousarray(patterns.T)
    active, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    for _ in range(rounds):
        error = weight * (histogram - _made(patterns[active], x, len(histogram)))
        slope = error[columns[0]] + error[columns[1]] + error[columns[2]]
        slope[active] = 0
        steep = np.flatnonzero(slope > least)
        if not len(steep):
            break
        if len(steep) > entering:
            steep = steep[np.argpartition(-slope[steep], entering)[:entering]]
        new = steep[_without_shared_lengths(patterns[steep], slope[steep])]
        active, x = np.append(active, new), np.append(x, np.zeros(len(new)))
        while len(x):
            aim = _least_squares(patterns[active], histogram, weight, x)
            down = aim < 0
            if not down.any():
                x = aim
                break
            x = x + (x[down] / (x[down] - aim[down])).min() * (aim - x)
            keep = ~(down & (x <= 1e-9))
            active, x = active[keep], np.maximum(x[keep], 0)
    return active[x > 0], x[x > 0]


def pattern_bins(histogram: np.ndarray, capacity: int) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """Full sequences as (lengths, repeats), and the histogram of what they leave over.

    Fitted repeats are rounded down; then patterns take one more each, by falling remainder, while
    all their lengths are left; and what is left is fitted again until patterns place hardly anything.
    """
    left, bins = histogram.astype(np.int64).copy(), []
    left[0] = 0
    while left.any():
        patterns = exact_patterns(left > 0, capacity)
        if not len(patterns):
            break
        active, repeats = fit_repeats(patterns, left.astype(float))
        placed = 0
        whole = np.floor(repeats + 1e-6)
        for order, times in ((np.argsort(-whole, kind="stable"), whole), (np.argsort(whole - repeats, kind="stable"), np.ones(len(whole)))):
            for i in order.tolist():
                contents = [x for x in patterns[active[i]].tolist() if x]
                n = min(int(times[i]), *(int(left[x]) // contents.count(x) for x in contents))
                if n > 0:
                    bins.append((contents, n))
                    placed += n * len(contents)
                    for x in contents:
                        left[x] -= n
        if placed <= left.sum() // 100:
            break
    return bins, left


def best_fit_residuals(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing over a histogram, in bulk: bins with equal contents are one entry with a count."""
    by_room: dict[int, list[list]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                fill = capacity // length
                if left >= fill:
                    placed, contents = left // fill, [length] * fill
                else:
                    placed, contents = 1, [length] * left
                left -= placed * len(contents)
                room = capacity - length * len(contents)
                by_room[room].append([contents, placed])
                rooms[room] = True
                continue
            room = length + int(fitting[0])
            contents, count = by_room[room].pop()
            placed = min(left, count)
            if count > placed:
                by_room[room].append([contents, count - placed])
            rooms[room] = bool(by_room[room])
            by_room[room - length].append([[*contents, length], placed])
            rooms[room - length] = True
            left -= placed
    return [(contents, count) for entries in by_room.values() for contents, count in entries]


@dataclass(frozen=True)
class Plan:
    """For slot i: pieces of ``length[i]`` with rank in [first[i], first of the next slot of that length)."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def packing_plan(histogram: np.ndarray, capacity: int) -> Plan:
    """The packing of a histogram of lengths (index = length)."""
    bins, left = pattern_bins(histogram, capacity)
    bins += best_fit_residuals(left, capacity)
    slots, taken, base = [], defaultdict(int), 0
    for contents, times in bins:
        offset = 0
        for x in contents:
            slots.append((x, taken[x], base, offset))
            taken[x] += times
            offset += x
        base += times
    columns = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences=base)


def _placer(plan: Plan):
    code = (plan.length << 44) + plan.first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(code, (length << 44) + rank, side="right") - 1
            sequence = plan.sequence[slot] + rank - plan.first[slot]
            columns = [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(plan.offset[slot])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def ranked_in_groups(rows: DataFrame, group: str, order: list[str], cells: int) -> DataFrame:
    """``rows`` with ``rank``, from 0 without gaps in each group, in a deterministic order of cells, then ``order``.

    The cell is a hash of ``order``; a group's rows are spread over ``cells`` tasks, and only
    counts per (group, cell) are summed up in one place per group.
    """
    celled = rows.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = celled.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("cell")) - F.col("n")
    firsts = counts.select(group, "cell", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(group, "cell").orderBy(*order))
    joined = celled.join(firsts, [group, "cell"])
    return joined.withColumn("rank", F.col("before") + within - 1).drop("cell", "before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cells: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in a sequence).

    ``cells`` spreads each length over so many tasks (the session's shuffle partitions by default).
    Null and empty texts are the single id ``end_id``; repeated rows are packed once each; a null
    doc_id stays null; an empty table gives no rows; further columns are ignored. The tokenized
    pieces are staged in the shared folder, so texts are encoded once.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    plan = packing_plan(histogram, capacity)
    ranked = ranked_in_groups(cut, "length", ["doc_id", "piece", "ids_crc32"], cells or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranked.mapInArrow(_placer(plan), f"{PIECES}, sequence_id long, offset long")
