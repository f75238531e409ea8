"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers, and equal ones are grouped with their
multiplicity. Lloyd's rounds run on the distinct vectors: every task assigns its
own and adds up integer sums, weighted by multiplicity, which are merged in a
tree; the centroids (k rows) are all that the driver holds. At the end the
assignments are joined back to the ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .integer_vectors import distinct_vectors, matrix, quantised, tree_sum

CLUSTERS, ROUNDS, DIM, SALT = 40, 5, 64, "2:"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of integer rows, exact; ties go to the smaller number."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # every sum is a whole number that doubles hold
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best].astype(np.int64)


def weighted_sums(x: np.ndarray, n: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """A row a cluster: its vectors' number, then their sums."""
    best, _ = nearest(x, centroids)
    order = np.argsort(best, kind="stable")
    starts = np.flatnonzero(np.diff(best[order], prepend=-1))
    rows = np.column_stack([n, x * n[:, None]])[order]
    out = np.zeros((len(centroids), x.shape[1] + 1), np.int64)
    out[best[order][starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k rows whose salted ids have the smallest hashes, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    taken = rows.select(digest.alias("h"), "vec_id", "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r.q for r in taken], np.int64)


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        now = centroids
        part = lambda b: weighted_sums(matrix(b.column(0)), b.column(1).to_numpy(), now)  # noqa: E731, B023
        total = tree_sum(distinct.select("q", "n"), part, (len(now), now.shape[1] + 1), np.int64)
        held = total[:, 0] > 0
        centroids = now.copy()
        centroids[held] = total[held, 1:] // total[held, :1]  # rounds down, below zero too
    return centroids


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if len(batch):
                best, far = nearest(matrix(batch.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best, pa.int32()), pa.array(far)], ["digest", "n", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, salt: str = SALT) -> DataFrame:
    """One row per vector of dim components, none null or non-finite: vec_id,
    cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Other rows are left out. Rows that repeat an id or a vector count as one
    each; a null id comes last among the first centroids, ties by the vector.
    Fewer than k vectors give as many centroids; an empty table gives an empty
    one. Components of 65,536 and more count as that. Other columns aren't
    carried, whatever their names.
    """
    rows = quantised(vectors, id_col, vec_col, dim)
    distinct = distinct_vectors(rows)
    spark = vectors.sparkSession
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(spark.createDataFrame([], schema), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    centroids = lloyd(distinct, centroids, rounds)
    assigned = materialize(distinct.select("digest", "q", "n").mapInArrow(_assign(centroids), "digest binary, n long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("s")).collect()}  # k rows
    digests = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in inertia}
    of_cluster = spark.createDataFrame([(c, s, sum(inertia.values()), digests[c]) for c, s in inertia.items()], schema)
    out = rows.select("vec_id", "digest").join(assigned.select("digest", "cluster", "distance"), "digest")
    return out.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
