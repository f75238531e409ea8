"""Vectors of integers: floor(256 x) of every component, each distinct one once.

Shared by the operators that count in exact integers. Partial results of tasks
are merged over the executors in a tree, so that the driver gets one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize

SCALE = 256.0
#: components beyond this, so that sums of squared differences of 4096 of them are long integers
LARGEST = 1 << 24


def quantised(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(vec_id, digest, q) of the rows whose vector is usable: not null, without
    null or non-finite components, and of dim components where that is given.

    q is floor(256 x), x as double; beyond +-LARGEST (components of 65,536 and
    more) it is LARGEST. Equal digests are equal q. Ids are carried as they
    are, null and repeated ones too. Written as a table.
    """
    wide = column(df, vec_col).cast("array<double>")
    fine = ~F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    if dim is not None:
        fine &= F.size(wide) == dim
    most = F.lit(float(LARGEST))
    whole = F.transform(wide, lambda v: F.floor(F.least(F.greatest(v * SCALE, -most), most)).cast("int"))
    rows = df.where(wide.isNotNull() & F.coalesce(fine, F.lit(False))).select(column(df, id_col).alias("vec_id"), whole.alias("q"))
    digest = F.unhex(F.sha2(F.array_join(F.col("q").cast("array<string>"), ","), 256))
    return materialize(rows.select("vec_id", digest.alias("digest"), "q"), "quantised")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(digest, q, n): each vector once, with the number of its rows. Rows are
    counted before they are shuffled, so that copies are no hot key."""
    return materialize(rows.groupBy("digest", "q").agg(F.count(F.lit(1)).alias("n")), "distinct")


def matrix(q: pa.ListArray) -> np.ndarray:
    """Rows of long integers, of lists of one length."""
    return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(q), -1)


def tree_sum(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """The sum of part over all batches: a task adds up its own, then sums are merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            if len(batch):
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(total: np.ndarray, row) -> np.ndarray:
        return total + np.frombuffer(row[0], dtype).reshape(shape)

    return rows.mapInArrow(run, "part binary").rdd.treeAggregate(np.zeros(shape, dtype), add, np.add, depth=3)
