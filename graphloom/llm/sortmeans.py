"""Centroid clustering by sort-means (Phillips, "Acceleration of k-means and related clustering algorithms", 2002).

Vectors are whole numbers, so all distances, sums and means are exact and the result doesn't depend on how rows are dealt
to tasks. In each round the distances between all centroids are taken once and, for each centroid, the others put in
order. A vector starts at the centroid that it had in the round before, at distance d, and tries the others in that
one's order. By the triangle inequality a centroid that is more than 2 d away from it can't be as near, so the scan stops
there; one exactly 2 d away is still tried, as it may tie, and of equal distances the smaller number wins.

Centroids are `k` rows, which is all that the driver and every task hold besides a slice of vectors. A round writes the
vectors with their centroids to shared storage, adds up each centroid's vectors in one aggregate with partial sums, and
frees the table of the round before; no vector is ever shuffled.

Vectors that are null, of another length, or have a null, NaN or infinite component are left out. So are none with a null
id, but no such vector is a first centroid. Repeated rows are vectors of their own. If fewer than `k` vectors
are left, each with an id is a centroid; without one the result is empty. Components beyond LIMIT in size are refused with an
error, as their squared distances would not fit in 64 bits. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, materialize
from graphloom.operators.scratch import release

#: Whole components have at most this size: 64 squares of twice it fit in 63 bits.
LIMIT = 1 << 27


def whole_vectors(vectors: DataFrame, column: str, size: int, scale: int) -> DataFrame:
    """The rows with `size` finite components, `column` as floor(scale * x) of each."""
    v = F.col(column).cast("array<double>")
    fits = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is not less

    def whole(x: Column) -> Column:
        n = F.floor(x * scale)
        return F.when(F.abs(x * scale) <= LIMIT, n).otherwise(F.raise_error(F.lit(f"a component exceeds {LIMIT}"))).cast("int")

    return vectors.where(fits).withColumn(column, F.transform(v, whole))


def first_centroids(vectors: DataFrame, order: Column, column: str, k: int) -> np.ndarray:
    """The `k` vectors that come first by `order`, of equals by their components; null orders are left out."""
    rows = vectors.select(order.alias("o"), column).where("o IS NOT NULL").orderBy("o", column).limit(k).collect()
    return np.array([r[column] for r in rows], np.int64)


def nearest(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroid of each vector and its squared distance, and how many distances that took."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    away = np.take_along_axis(between, order, axis=1)
    best, distance = previous.copy(), ((x - centroids[previous]) ** 2).sum(axis=1)
    reach, tried = 4 * distance, len(x)  # of squares
    left = np.arange(len(x))
    for place in range(len(centroids)):
        left = left[away[previous[left], place] <= reach[left]]
        if not len(left):
            break
        other = order[previous[left], place]
        d = ((x[left] - centroids[other]) ** 2).sum(axis=1)
        tried += len(left)
        wins = (d < distance[left]) | ((d == distance[left]) & (other < best[left]))
        best[left[wins]], distance[left[wins]] = other[wins], d[wins]
    return best, distance, tried


def assign(vectors: DataFrame, centroids: np.ndarray, column: str) -> DataFrame:
    """The rows (any columns, the vector and `cluster`, where the scan starts) with the nearest cluster and its distance."""
    names = [c for c in vectors.columns if c not in ("cluster", "distance")]
    kinds = dict(vectors.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "cluster int", "distance bigint"])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column(column).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            best, distance, _ = nearest(x, batch.column("cluster").to_numpy().astype(np.int64), centroids)
            cols = [*(batch.column(c) for c in names), pa.array(best.astype(np.int32)), pa.array(distance)]
            return pa.RecordBatch.from_arrays(cols, names=[*names, "cluster", "distance"])

        return run

    return map_batches(vectors.select(*names, "cluster"), make, schema)


def means(assigned: DataFrame, centroids: np.ndarray, column: str) -> np.ndarray:
    """floor(sum / count) of each centroid's vectors; centroids without any stay."""
    sums = [F.sum(F.col(column)[i].cast("bigint")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def sort_means(vectors: DataFrame, centroids: np.ndarray, rounds: int, column: str) -> tuple[DataFrame, np.ndarray]:
    """(the rows with cluster and squared distance, the final centroids) after `rounds` rounds and a last assignment."""
    now = vectors.withColumn("cluster", F.lit(0))  # the first scan starts at the first centroid
    for _ in range(rounds):
        last, now = now, materialize(assign(now, centroids, column))
        release(last)
        centroids = means(now, centroids, column)
    out = materialize(assign(now, centroids, column))
    release(now)
    return out, centroids


def cluster(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", size: int = 64, scale: int = 256, k: int = 40, rounds: int = 5
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that is kept.

    The first centroids are the vectors with the least SHA-256 of `2:<key>`.
    """
    kept = whole_vectors(vectors.select(key, column), column, size, scale)
    order = F.sha2(F.concat(F.lit("2:"), F.col(key).cast("string")), 256)
    first = first_centroids(kept, order, column, k)
    kind = dict(vectors.dtypes)[key]
    if not len(first):
        schema = f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    found, last = sort_means(kept, first, rounds, column)
    spread = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    total = int(sum(r["d"] for r in spread))
    rows = [
        (r["cluster"], int(r["d"]), total, hashlib.sha256(",".join(map(str, last[r["cluster"]].tolist())).encode()).hexdigest())
        for r in spread
    ]
    each = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
