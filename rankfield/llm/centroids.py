"""Centroid clustering of integer vectors by exact, incrementally kept dot products.

The table of vectors carries the dot product of each vector with every centroid. A round takes the
nearest centroids from the stored products (squared norms complete the distances), sums the
vectors of each cluster, and moves the centroids. Products then change by the vector's components
times the centroid's changes, so only components in which a centroid has moved are read and
multiplied. All numbers are 64-bit integers and exact: |v|^2, products and sums stay below 2^63 as
long as components are below 2^27 in size and sums of a cluster below 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.tables import discard, staged

_STATE = "vec_id long, vector array<long>, norm long, dots array<long>, cluster int, distance long"


def integer_vectors(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """(vec_id, vector) of the rows with exactly ``components`` finite components, as floor(scale * x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == components)).filter(~bad)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return kept.select(F.col("vec_id").cast("long"), whole.alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256 with the seed, in that order; ties by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.orderBy(order, "vector").limit(k).select("vector").collect()  # k rows, a parameter
    return np.array([row["vector"] for row in rows], dtype=np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def _state(ids: pa.Array, vectors: pa.Array, norms: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    """The new products and, from them, the nearest centroid; the first of equally near ones."""
    distances = norms[:, None] - 2 * dots + (centroids * centroids).sum(1)
    cluster = distances.argmin(1)
    distance = distances[np.arange(len(cluster)), cluster]
    arrays = [ids, vectors, pa.array(norms), _lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)]
    return pa.RecordBatch.from_arrays(arrays, names=["vec_id", "vector", "norm", "dots", "cluster", "distance"])


def _begun(centroids: np.ndarray):
    """All products of each vector with the first centroids."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("vector"), centroids.shape[1])
                yield _state(batch.column("vec_id"), _lists(vectors), (vectors * vectors).sum(1), vectors @ centroids.T, centroids)

    return begin


def _moved(change: np.ndarray, centroids: np.ndarray):
    """The stored products, changed where centroids have."""
    moved = [(c, np.flatnonzero(change[c])) for c in np.flatnonzero(change.any(1))]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, dots = _matrix(batch.column("vector"), centroids.shape[1]), _matrix(batch.column("dots"), len(centroids)).copy()
                for c, parts in moved:
                    dots[:, c] += vectors[:, parts] @ change[c, parts]
                yield _state(batch.column("vec_id"), _lists(vectors), batch.column("norm").to_numpy(), dots, centroids)

    return move


def _partial_sums(k: int, width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each cluster of a task: how many vectors, and their sum."""
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            vectors = _matrix(batch.column("vector"), width)
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += vectors[cluster == c].sum(0)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), _lists(total[some])], names=["cluster", "n", "total"])

    return add


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of the vectors of each cluster; a centroid without vectors stays."""
    k, width = centroids.shape
    parts = state.select("cluster", "vector").mapInArrow(_partial_sums(k, width), "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most k rows
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int, components: int, scale: int) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), the final centroids) after ``rounds`` rounds and one more assignment.

    Vectors that are null, of another length, or hold null or non-finite components take no part.
    Fewer vectors than ``k`` give as many centroids as there are vectors; none give no rows. Rows
    that repeat a vec_id, or have none, are vectors of their own; further columns are ignored. Runs
    two jobs a round when called; the driver holds the centroids alone.
    """
    whole = staged(integer_vectors(vectors, components, scale), "vectors")
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids.reshape(0, components)
    state = staged(whole.mapInArrow(_begun(centroids), _STATE), "products")
    discard(whole)
    for _ in range(rounds):
        means = _means(state, centroids)
        change, centroids = means - centroids, means
        if not change.any():
            break  # the products, and with them all later rounds, stay as they are
        later = staged(state.mapInArrow(_moved(change, centroids), _STATE), "products")
        discard(state)
        state = later
    return state.select("vec_id", "cluster", "distance"), centroids


def inertia(assigned: DataFrame) -> tuple[Column, Column]:
    """(inertia of the row's cluster, of all) as columns over ``assigned``; one job, a row for each cluster."""
    sums = {row["cluster"]: row["inertia"] for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    per_cluster = F.array(*(F.lit(sums.get(c, 0)).cast("long") for c in range(max(sums, default=0) + 1)))
    return per_cluster[F.col("cluster")], F.lit(sum(sums.values())).cast("long")
