"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors become integers, ``floor(scale * x)`` of each component. In every round a task keeps, for
each dimension, a table of the squared difference between every integer that occurs there and
every centroid; the distances of a batch are gathers from these tables, summed over the
dimensions. A value not met before is added to its table. All sums are of integers, so the
result doesn't depend on how the rows are dealt to tasks.

A round is one scan. A task sends a count, and a sum for each dimension, for each centroid, however
many vectors it has read or one cluster holds; the driver gets those of all tasks added up, which
are ``clusters * (dimensions + 1)`` numbers. The last assignment is written, then summed.

Rows whose vector is NULL, has another length, or has NULL, NaN or infinite components are left
out. Every row that is kept counts: repeated rows and equal vectors are assigned alike. A NULL
``id`` is kept and, as it has no hash, starts a cluster only where too few other rows exist. Of
equal hashes (a repeated id) the smaller vector goes first. Fewer rows than clusters give as many
clusters as rows; an empty table gives no rows. Extra columns are left out. Integers of more
than ``LARGEST`` are refused: squared distances between them could exceed a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedonica.session import literal_rows, written

LARGEST = 1 << 26
# Integers a dimension's table may hold; beyond, a task begins its tables anew.
TABLE_VALUES = 1 << 14
# Vectors taken at a time; their distances are 128 bytes each for 16 clusters.
STEP = 4096
ASSIGNED = "id bigint, cluster int, distance bigint"


@dataclass(frozen=True)
class Clusters:
    """``assigned``: id, cluster, distance of every vector kept; ``centroids``: final ones."""

    assigned: DataFrame
    centroids: list[list[int]]


class Tables:
    """Squared differences to the centroids, for each dimension and integer that occurred."""

    def __init__(self, centroids: np.ndarray, most: int = TABLE_VALUES):
        self.centroids, self.most = centroids, most
        dims = centroids.shape[1]
        self.values = [np.zeros(0, dtype=np.int64)] * dims
        self.squares = [np.zeros((0, len(centroids)), dtype=np.int64)] * dims

    def add(self, dim: int, column: np.ndarray, missing: np.ndarray) -> None:
        known, new = self.values[dim], np.unique(column[missing])
        if len(known) + len(new) > self.most:
            known, new = known[:0], np.unique(column)
        self.values[dim] = values = np.union1d(known, new)
        self.squares[dim] = (values[:, None] - self.centroids[:, dim]) ** 2

    def places(self, dim: int, column: np.ndarray) -> np.ndarray:
        """Where the column's integers lie in the dimension's table, which gets the new ones."""
        known = self.values[dim]
        at = np.searchsorted(known, column)
        missing = np.ones(len(column), dtype=bool)
        if len(known):
            missing = known[np.minimum(at, len(known) - 1)] != column
        if missing.any():
            self.add(dim, column, missing)
            at = np.searchsorted(self.values[dim], column)
        return at

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances, a row for each vector and a column for each centroid."""
        out = np.zeros((len(vectors), len(self.centroids)), dtype=np.int64)
        for dim in range(vectors.shape[1]):
            at = self.places(dim, vectors[:, dim])  # may change the table
            out += self.squares[dim][at]
        return out

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (of equally near ones the first) and the distance to it."""
        found = self.distances(vectors)
        cluster = found.argmin(axis=1)
        return cluster, found[np.arange(len(found)), cluster]


def kept(vector: str, dimensions: int) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))


def integers(df: DataFrame, id_column: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """``id, vector`` (longs) of the rows kept."""
    large = f"a component of more than {LARGEST // scale}: its distances could exceed a long"

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(x) > LARGEST // scale, F.raise_error(F.lit(large)).cast("bigint")).otherwise(scaled)

    return df.where(kept(vector, dimensions)).select(
        F.col(id_column).cast("long").alias("id"), F.transform(vector, whole).alias("vector")
    )


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(clusters)
    return [list(r["vector"]) for r in first.select("vector").collect()]


def in_steps(batches: Iterator[pa.RecordBatch], dimensions: int):
    """Ids and vectors of the batches, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0), flat.reshape(-1, dimensions)


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``cluster, dim, total``: sums over the vectors nearest to each centroid; dim -1 counts."""
    dims, k = len(centroids[0]), len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(np.array(centroids, dtype=np.int64))
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for _, found in in_steps(batches, dims):
            cluster, _ = tables.nearest(found)
            total[:, 0] += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c, 1:] += found[cluster == c].sum(axis=0)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(d - 1, pa.int32()), pa.array(total[c, d])],
            names=["cluster", "dim", "total"],
        )

    parts = vectors.mapInArrow(sums, "cluster int, dim int, total bigint")
    return parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"))


def moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    """Every non-empty centroid replaced by floor(sum / count) of its vectors."""
    total = {(r["cluster"], r["dim"]): r["total"] for r in sums}
    out = []
    for c, old in enumerate(centroids):
        n = total.get((c, -1), 0)
        out.append([total.get((c, d), 0) // n for d in range(len(old))] if n else old)
    return out


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    dims = len(centroids[0])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(np.array(centroids, dtype=np.int64))
        for ids, found in in_steps(batches, dims):
            cluster, distance = tables.nearest(found)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array(distance)],
                names=["id", "cluster", "distance"],
            )

    return vectors.mapInArrow(nearest, ASSIGNED)


def cluster_vectors(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dimensions: int = 64,
    clusters: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1,
) -> Clusters:
    """``rounds`` times assign all vectors and move the centroids; then assign once more."""
    vectors = integers(df, id_column, vector, dimensions, scale)
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        return Clusters(literal_rows(df.sparkSession, [], ASSIGNED), [])
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(vectors, centroids).collect())
    return Clusters(written(assign(vectors, centroids), "assigned"), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """Each vector's row with the distance summed over its cluster and over all, and the
    SHA-256 of its centroid's components."""
    spark = found.assigned.sparkSession
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    rows = [
        (r["cluster"], r["s"], sum(x["s"] for x in sums),
         hashlib.sha256(",".join(map(str, found.centroids[r["cluster"]])).encode()).hexdigest())
        for r in sums
    ]
    summed = literal_rows(
        spark, rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return found.assigned.join(F.broadcast(summed), "cluster")
