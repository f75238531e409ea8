"""Embedding whitening by a two-pass covariance.

First pass: exact integer sums of the distinct quantised vectors give the mean.
Second pass: every task adds up the outer products of its centred rows, a matrix
product a batch; the sums are merged in a tree. The symmetric eigenproblem of
that one d x d matrix is solved on the driver, and the projection (d x 4) goes
to the tasks. A third pass measures the covariance of what comes out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integer_vectors import distinct_vectors, matrix, quantised, tree_sum

COMPONENTS = 4
#: eigenvalues under this share of the trace are rounding: there is nothing to whiten in their direction
FLAT = 1e-13
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, distance double"


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sums of (n x - S)^2, exact; null where that is no long integer."""
    top = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if x.shape[1] * top * top < 1 << 63:
        return pa.array(((n * x - sums) ** 2).sum(axis=1), pa.int64())
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> dict:
    """The model of distinct vectors of dim components: n, sums, values and
    vectors of the first components, trace, and the error of the identity."""
    q = distinct.where(F.size("q") == dim).select("q")
    counted = lambda b: np.concatenate([[len(b)], matrix(b.column(0)).sum(axis=0)])
    n, *sums = (int(v) for v in tree_sum(q, counted, (dim + 1,), np.int64))
    mean = np.array([s / n for s in sums])

    def products(b):
        z = matrix(b.column(0)) - mean
        return z.T @ z

    covariance = tree_sum(q, products, (dim, dim), np.float64) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    steep = values > FLAT * max(trace, 0.0)
    scaled = vectors / np.sqrt(np.where(steep, values, 1.0))
    model = {"n": n, "sums": np.array(sums, np.int64), "mean": mean, "values": values, "vectors": vectors, "trace": trace, "steep": steep, "scaled": scaled, "error": None}
    if steep.any():

        def white(b):
            w = (matrix(b.column(0)) - mean) @ scaled[:, steep]
            return w.T @ w

        m = int(steep.sum())
        model["error"] = float(np.abs(tree_sum(q, white, (m, m), np.float64) / n - np.eye(m)).max())
    return model


def _project(model: dict, dim: int, components: int):
    m = len(model["values"])
    explained = [v / model["trace"] if model["trace"] > 0 else None for v in model["values"].tolist()]

    def rows(ids, deviation, whitened, distance, width):
        k = len(ids)
        each = pa.array(np.repeat(np.arange(k), width))
        tiled = lambda v, t: pa.array(list(v) * k, t)
        full = lambda v, t: pa.array([v] * (k * width), t)
        return pa.RecordBatch.from_arrays(
            [ids.take(each), tiled(range(1, width + 1), pa.int32()), full(model["n"], pa.int64()), deviation.take(each), whitened,
             tiled((explained + [None] * width)[:width], pa.float64()), full(model["error"], pa.float64()), distance.take(each)],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "distance"],
        )

    def run(batches):
        for batch in batches:
            ids, q = batch.column(0), batch.column(1)
            lengths = q.value_lengths().to_numpy(zero_copy_only=False)
            here = np.flatnonzero(lengths == dim)
            if len(here):
                at = pa.array(here)
                x = matrix(q.take(at))
                z = x - model["mean"]
                white = np.where(model["steep"], z @ model["scaled"], np.nan).ravel()
                yield rows(ids.take(at), deviations(x, model["n"], model["sums"]), pa.array(white, from_pandas=True), pa.array(np.sqrt((z * z).sum(axis=1))), m)
            for width in np.unique(np.minimum(lengths[lengths != dim], components)).tolist():
                at = pa.array(np.flatnonzero((lengths != dim) & (np.minimum(lengths, components) == width)))
                yield rows(ids.take(at), pa.nulls(len(at), pa.int64()), pa.nulls(len(at) * width, pa.float64()), pa.nulls(len(at), pa.float64()), width)

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row whose vector is not null and holds no null or non-finite
    entry, a row per component (up to four, no more than entries): vec_id,
    component, n, deviation, whitened, explained, identity_error, and distance,
    the length of the centred vector.

    The fit is over the distinct vectors of the most frequent length (of equally
    frequent ones, the longest). Rows of other lengths have null deviation,
    whitened and distance; an empty vector has no component. A direction in which nothing
    varies has null whitened, and isn't in identity_error; with no variance at
    all explained is null too. deviation is null where it exceeds a long
    integer. Rows that repeat an id or a vector come out as often; null ids
    stay. Entries of 65,536 and more count as that. An empty table gives an
    empty one; other columns aren't carried, whatever their names.
    """
    rows = quantised(vectors, id_col, vec_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    lengths = rows.where(F.size("q") > 0).groupBy(F.size("q").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), f"vec_id {kind}, {OUT}")
    model = fit(distinct_vectors(rows), lengths["dim"], components)
    return rows.select("vec_id", "q").mapInArrow(_project(model, lengths["dim"], components), f"vec_id {kind}, {OUT}")
