"""Nearest neighbours by inner product with an adaptive dimension scan over inverted lists.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the
smallest distance, and are rotated by a random orthogonal matrix. Lists are cells of k-means
centres, as many as grow with the root of the table, up to a share of the sample. A query probes the
lists with the best expected member. In a list the squared distance is summed over column blocks of
the rotated vectors; after each block a hypothesis test abandons candidates early: under a random
rotation the share of a distance that lies in some of the columns follows a beta distribution, and
a candidate goes when its partial distance exceeds the upper quantile that a candidate at the
query's bound would have. The bound is the k-th best score so far: of the sample, then of the
query's home group of lists, then from list to list. Survivors are scored exactly, in double
precision, on the original vectors.

Scale: centres, rotation and probe count are fitted on a sample of at most ``sample`` vectors; every
vector is indexed. Neighbouring lists form groups, about the cube root of the table in number; a
vector goes to one group, a query once to each group in which it probes lists. Groups beyond a
block are split into blocks and their queries into chunks, so no list, however hot, meets in one
task; a task compares queries with a list in slices of ``CELLS`` pairs. Of equal vectors only the
k + 1 of smallest id can be anyone's neighbours, so only these become candidates. Queries left with
fewer than k rows are scanned again over all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.tables import discard, staged

#: Candidates of a block and queries of a chunk at most, about.
MOST_BLOCK, MOST_CHUNK = 65_536, 65_536
#: Pairs of a query and a candidate held as matrices at a time, and pairs followed one by one at a time.
CELLS, PAIRS = 2_000_000, 100_000
#: Width of a column block.
COLUMNS = 16
#: How often the test abandons a candidate that lies at the bound.
ERROR = 0.001
#: Share of candidates alive below which they are followed pair by pair.
DENSE = 0.1
#: Share of true neighbours within the probed lists, on the sample.
COVER = 0.98
#: Sampled vectors for each centre at least.
PER_CENTRE = 8


@dataclass
class Index:
    """What is fitted; its size depends on the sample bound and the dimension alone."""

    top_norm: float
    rotation: np.ndarray
    centres: np.ndarray
    gains: np.ndarray
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray
    groups: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int32))

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.rotation).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part.

    Null, zero, ragged (not of the most frequent dimension) vectors and those holding nulls or
    non-finite components do not; nor do rows without vec_id. Floats stay floats, other numbers are doubles.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    value = F.col("embedding").cast("array<float>" if single else "array<double>")
    finite = F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long"), value.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    )
    common = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("embedding") == (common["n"] if common else 0))


def candidates(known: DataFrame, k: int) -> DataFrame:
    """The distinct rows of ``known``, of equal vectors those of the k + 1 smallest ids."""
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return known.withColumn("place", place).filter(F.col("place") <= k + 1).dropDuplicates(["embedding", "vec_id"]).drop("place")


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(float).reshape(rows, -1)


def lifted(x: np.ndarray, top_norm: float) -> np.ndarray:
    """``x`` with the coordinate that makes every row's norm ``top_norm``."""
    return np.concatenate([x, np.sqrt(np.maximum(top_norm**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found = a @ b.T
    found *= -2
    found += (a * a).sum(axis=1)[:, None]
    found += (b * b).sum(axis=1)
    return found


def ranked_lists(q: np.ndarray, centres: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Lists of each query by the inner product to be expected of their best member.

    That is the centre's, and by how much the best of a list's members exceeds it: spread times
    the usual height of the largest of so many normal deviations. A tight list gains nothing.
    """
    return np.argsort(-(q @ centres[:, :-1].T + gains), axis=1, kind="stable")


def _grouped(centres: np.ndarray, counts: np.ndarray, parts: int) -> np.ndarray:
    """The group of each centre: halves across the widest direction, of near equal counts, until there are ``parts``."""
    groups = np.zeros(len(centres), dtype=np.int32)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        groups[rows] = first
        if n < 2 or len(rows) < 2:
            return
        spread = centres[rows] - centres[rows].mean(axis=0)
        rows = rows[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
        total = np.cumsum(counts[rows])
        at = min(max(1, int(np.searchsorted(total, total[-1] * (n // 2) / n))), len(rows) - 1)
        split(rows[:at], first, n // 2)
        split(rows[at:], first + n // 2, n - n // 2)

    split(np.arange(len(centres)), 0, parts)
    return np.unique(groups, return_inverse=True)[1].astype(np.int32)


def fit_index(vectors: DataFrame, k: int, sample: int, seed: int = 3) -> Index | None:
    """An index fitted on the ``sample`` vectors of smallest hashed id."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows, top_norm = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not rows:
        return None
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toArrow()
    x, ids = _matrix(drawn["embedding"], drawn.num_rows), drawn["vec_id"].to_numpy()
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1] + 1, x.shape[1] + 1)))[0]
    y = lifted(x, top_norm)
    lists = max(1, min(int(2 * rows**0.5), len(y) // PER_CENTRE))
    centres = y[rng.permutation(len(y))[:lists]]
    for _ in range(8):
        nearest = np.argmin(_distances(y, centres), axis=1)
        counts = np.bincount(nearest, minlength=lists)
        sums = np.stack([np.bincount(nearest, weights=column, minlength=lists) for column in y.T], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    nearest = np.argmin(_distances(y, centres), axis=1)
    counts = np.maximum(np.bincount(nearest, minlength=lists), 2)
    residue = np.bincount(nearest, weights=((y - centres[nearest]) ** 2).sum(axis=1), minlength=lists) / counts
    gains = np.sqrt(residue / y.shape[1] * 2 * np.log(np.maximum(counts * rows / len(y), 2)))
    probes = lists
    if len(y) > 40 * k:
        # of a neighbourhood of k in the table so many are in the sample
        near = max(1, round(k * len(y) / rows))
        asked = rng.permutation(len(y))[:400]
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-scores, near, axis=1)[:, :near]
        place = np.argsort(ranked_lists(x[asked], centres, gains), axis=1)
        probes = 1 + int(np.quantile(np.take_along_axis(place, nearest[best], axis=1), COVER))
    parts = min(lists, max(1, int(rows ** (1 / 3) / 2)))
    return Index(top_norm, rotation, centres, gains, min(probes, lists), x, ids, _grouped(centres, counts, parts))


LISTED = "vec_id long, embedding {kind}, list int, group int"
PROBE = "query_id long, twin long, query {kind}, bound double, group int, lists array<int>"
FOUND = "query_id long, twin long, vec_id long, score double"


def _assigner(index: Index):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                y = lifted(_matrix(part["embedding"], part.num_rows), index.top_norm)
                nearest = np.argmin(_distances(y, index.centres), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["embedding"], pa.array(nearest), pa.array(index.groups[nearest])], names=["vec_id", "embedding", "list", "group"])

    return assign


def _sample_bound(index: Index, k: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The k-th best score of each query among the sample's other rows; minus infinity where there are fewer."""
    scores = x @ index.sample.T
    own = np.nonzero(ids[:, None] == index.sample_ids)
    scores[own] = np.where((x[own[0]] == index.sample[own[1]]).all(axis=1), -np.inf, scores[own])
    if scores.shape[1] <= k:
        return np.full(len(x), -np.inf)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def _prober(index: Index, k: int, home: bool | None):
    """Queries as rows of groups with the lists that they probe there: of their best list's group, the others, or (None) all lists of all groups."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part["query"], part.num_rows)
                if home is None:
                    chosen, bound = np.ones((len(x), len(index.centres)), dtype=bool), np.full(len(x), -np.inf)
                else:
                    order = ranked_lists(x, index.centres, index.gains)[:, : index.probes]
                    chosen = np.zeros((len(x), len(index.centres)), dtype=bool)
                    chosen[np.arange(len(x))[:, None], order] = True
                    chosen &= (index.groups == index.groups[order[:, 0]][:, None]) == home
                    bound = _sample_bound(index, k, part["query_id"].to_numpy(), x) if home else part["bound"].to_numpy(zero_copy_only=False)
                by_group = np.argsort(index.groups, kind="stable")
                row, place = np.nonzero(chosen[:, by_group])
                lists = by_group[place].astype(np.int32)
                begins = np.flatnonzero(np.diff(row * (index.groups.max() + 1) + index.groups[lists], prepend=-1))
                rows = pa.array(row[begins])
                columns = [part[c].take(rows) for c in ("query_id", "twin", "query")]
                columns += [pa.array(bound[row[begins]]), pa.array(index.groups[lists[begins]])]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(lists)).astype(np.int32)), pa.array(lists)))
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "twin", "query", "bound", "group", "lists"])

    return probe


_shares: dict[tuple[int, int], float] = {}


def _allowance(seen: int, dims: int) -> float:
    """The share of a squared distance that ``seen`` of ``dims`` rotated columns hold at most, but for ERROR of the cases."""
    if seen >= dims:
        return 1.0
    if (seen, dims) not in _shares:
        _shares[seen, dims] = float(np.quantile(np.random.default_rng(seen).beta(seen / 2, (dims - seen) / 2, 200_000), 1 - ERROR))
    return _shares[seen, dims]


def scan(index: Index, k: int, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score): up to k best candidates of each query in one list.

    Queries are taken in slices of at most CELLS pairs with the list, so memory does not grow with both sides.
    """
    return _scan(index, k, ids, x, index.rotated(lifted(x, index.top_norm)), query_ids, q, index.rotated(np.pad(q, ((0, 0), (0, 1)))), bound)


def _scan(index: Index, k: int, ids: np.ndarray, x: np.ndarray, y: np.ndarray, query_ids: np.ndarray, q: np.ndarray, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = max(1, CELLS // max(1, len(x)))
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for kind, survivors in ((np.isneginf(bound), _best_by_product), (~np.isneginf(bound), _survivors)):
        rows = np.flatnonzero(kind)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            row, candidate = survivors(index, k, x, y, q[some], p[some], bound[some])
            row, candidate, score = _ranked(k, ids, x, query_ids[some], q[some], row, candidate)
            found.append((some[row], candidate, score))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _best_by_product(index: Index, k: int, x: np.ndarray, y: np.ndarray, q: np.ndarray, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the k + 1 best of queries without a bound: nothing can be abandoned."""
    rough = q @ x.T
    if len(x) <= k + 1:
        return np.nonzero(np.ones(rough.shape, dtype=bool))
    least = -np.partition(-rough, k, axis=1)[:, k]
    return np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])


def _survivors(index: Index, k: int, x: np.ndarray, y: np.ndarray, q: np.ndarray, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no test abandons."""
    dims = y.shape[1]
    scale = (q * q).sum(axis=1) + index.top_norm**2
    reach = (np.maximum(scale - 2 * bound, 0) + 1e-5 * scale).astype(np.float32)  # squared distance at the bound, and rounding
    partial, seen, alive = np.zeros((len(q), len(y)), dtype=np.float32), 0, 1.0
    while seen < dims and alive > DENSE:  # many are alive: whole column blocks by matrix product
        at, seen = seen, min(seen + COLUMNS, dims)
        partial += _distances(p[:, at:seen], y[:, at:seen])
        keep = partial <= (reach * np.float32(_allowance(seen, dims)))[:, None]
        alive = np.count_nonzero(keep) / keep.size
    row, candidate = np.nonzero(keep)
    sums = partial[row, candidate]
    while seen < dims and len(row):  # few are alive: pair by pair
        at, seen = seen, min(seen + COLUMNS, dims)
        for first in range(0, len(row), PAIRS):
            some = slice(first, first + PAIRS)
            step = y[candidate[some], at:seen] - p[row[some], at:seen]
            sums[some] += np.einsum("ij,ij->i", step, step)
        lives = sums <= reach[row] * np.float32(_allowance(seen, dims))
        row, candidate, sums = row[lives], candidate[lives], sums[lives]
    return row, candidate


def _ranked(k: int, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, row: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row's candidates by exact scores, the query's own row left out."""
    own = np.flatnonzero(query_ids[row] == ids[candidate])
    own = own[(x[candidate[own]] == q[row[own]]).all(axis=1)]
    row, candidate = np.delete(row, own), np.delete(candidate, own)
    score = np.empty(len(row))
    for at in range(0, len(row), PAIRS):
        some = slice(at, at + PAIRS)
        score[some] = (x[candidate[some]] * q[row[some]]).sum(axis=1)
    return _first(k, ids, row, candidate, score)


def _first(k: int, ids: np.ndarray, row: np.ndarray, candidate: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[candidate], -score, row))
    row, candidate, score = row[order], candidate[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], candidate[place < k], score[place < k]


def _scanner(index: Index, k: int):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "twin": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left = left.sort_by([("list", "ascending"), ("vec_id", "ascending")])
        ids, cell, x = left["vec_id"].to_numpy(), left["list"].to_numpy(), _matrix(left["embedding"], left.num_rows)
        y = index.rotated(lifted(x, index.top_norm))
        query_ids, q, bound = right["query_id"].to_numpy(), _matrix(right["query"], right.num_rows), right["bound"].to_numpy().copy()
        p = index.rotated(np.pad(q, ((0, 0), (0, 1))))
        probed = right["lists"].combine_chunks()
        asks = np.repeat(np.arange(len(q)), np.diff(probed.offsets.to_numpy()))
        wanted = probed.flatten().to_numpy()
        asks, wanted = asks[order := np.argsort(wanted, kind="stable")], wanted[order]
        best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        waiting, pairs = [best], 0
        for number in np.unique(cell):
            a, b = np.searchsorted(cell, [number, number + 1])
            some = asks[slice(*np.searchsorted(wanted, [number, number + 1]))]
            row, candidate, score = _scan(index, k, ids[a:b], x[a:b], y[a:b], query_ids[some], q[some], p[some], bound[some])
            waiting.append((some[row], candidate + a, score))
            pairs += len(row)
            if pairs > k * len(q):  # the bounds tighten
                best = _first(k, ids, *(np.concatenate(part) for part in zip(*waiting, strict=True)))
                waiting, pairs = [best], 0
                last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                bound[best[0][last]] = np.maximum(bound[best[0][last]], best[2][last])
        row, candidate, score = _first(k, ids, *(np.concatenate(part) for part in zip(*waiting, strict=True)))
        return pa.table({"query_id": query_ids[row], "twin": right["twin"].to_numpy()[row], "vec_id": ids[candidate], "score": score})

    return compare


def _by_group(parts: list[int]) -> F.Column:
    """The number of blocks or chunks of the row's group; groups are about the cube root of the table in number and lists at most."""
    return F.get(F.array(*[F.lit(n) for n in parts]), F.col("group"))


def _scanned(index: Index, k: int, listed: DataFrame, probing: DataFrame, blocks: list[int]) -> DataFrame:
    """(query_id, twin, vec_id, score): what the probed lists give, up to k rows a query from each block.

    A group's candidates are copied once for each chunk of the queries that probe this group.
    """
    asking = {r["group"]: r["count"] for r in probing.groupBy("group").count().collect()}  # a number per group
    chunks = [-(-asking.get(g, 0) // MOST_CHUNK) for g in range(len(blocks))]
    left = listed.filter(_by_group(chunks) > 0).select(
        "group",
        F.pmod(F.xxhash64("vec_id", "embedding"), _by_group(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), _by_group(chunks) - 1)).alias("chunk"),
        "vec_id",
        "embedding",
        "list",
    )
    every = F.explode(F.sequence(F.lit(0), _by_group(blocks) - 1))
    chunk = F.pmod(F.xxhash64("query_id", "twin"), _by_group(chunks)).cast("int").alias("chunk")
    right = probing.select("group", every.alias("block"), chunk, "query_id", "twin", "query", "bound", "lists")
    key = ["group", "block", "chunk"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scanner(index, k), FOUND)


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: F.Column, k: int = 20, sample: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of ``vectors`` that ``queries`` selects.

    Candidates are all rows but the query's own; ties go to the smaller vec_id. Rows that repeat
    another's vec_id and vector count once; a vec_id with several vectors is a row for each, as a
    query too. Rows that ``usable`` leaves out take no part on either side; an empty table gives no
    rows; further columns are ignored. Fewer than k rows are returned only where fewer candidates
    exist: queries that the probed lists leave short are scanned again, over every list and without a bound.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    known = staged(candidates(rows, k), "vectors")
    index = fit_index(known, k, sample)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = known.schema["embedding"].dataType.simpleString()
    listed = staged(known.mapInArrow(_assigner(index), LISTED.format(kind=kind)), "lists")
    twin = F.xxhash64("embedding").alias("twin")
    asked = staged(rows.filter(queries).distinct().select(F.col("vec_id").alias("query_id"), twin, F.col("embedding").alias("query")), "queries")
    sizes = {r["group"]: r["count"] for r in listed.groupBy("group").count().collect()}  # a number per group
    blocks = [max(1, -(-sizes.get(g, 1) // MOST_BLOCK)) for g in range(index.groups.max() + 1)]
    spent = []

    def scanned(probing: DataFrame, home: bool | None) -> DataFrame:
        spent.append(staged(probing.mapInArrow(_prober(index, k, home), PROBE.format(kind=kind)), "probes"))
        return _scanned(index, k, listed, spent[-1], blocks)

    own = staged(_nearest_of(scanned(asked, True), k).drop("rank"), "home")
    reached = own.groupBy("query_id", "twin").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bounded = asked.join(reached, ["query_id", "twin"], "left").withColumn("bound", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")))
    found = staged(_nearest_of(own.unionByName(scanned(bounded, False)), k), "neighbours")
    enough = min(k, sum(sizes.values()) - 1)
    full = found.groupBy("query_id", "twin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select("query_id", "twin")
    short = asked.join(full, ["query_id", "twin"], "left_anti") if enough else asked.filter("false")
    result = found
    discard(known, own, *spent)
    if not short.isEmpty():
        result = found.join(full, ["query_id", "twin"], "left_semi").unionByName(_nearest_of(scanned(short, None), k))
    return result.select("query_id", "rank", "vec_id", "score")
