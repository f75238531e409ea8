"""Embedding near-duplicates by sorted projection passes.

Equal vectors are reduced to one first. In each pass vectors are ordered by the
concatenated bits of random hyperplanes, all of them, and each is compared with
the WINDOW that follow it: the order is cut into blocks, and the last WINDOW of a
block are carried into the next one, so that windows cross the borders of blocks
and partitions. What a pass compares is rows x WINDOW, however dense the vectors
lie.

A pass carries a vector's bytes (one a component) and not the vector. From them
a cosine is known to within a bound that is carried along: what is certainly
near is united at once, what may be near is looked at again with the vectors
themselves, pair by pair, or, where those are more than PAIRS a row, block by
block. The pairs of all passes are united, and the vectors of a component are then
compared in full, in blocks, so that links are counted exactly however many
vectors are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import UnionFind, column, connected_components, materialize, shuffle_partitions

COSINE, WINDOW, SEED = 0.95, 1024, 20_240
#: a pair at the threshold is missed by all passes with at most this probability, where vectors lie evenly
MISS = 4e-6
#: bits that order a pass, rows of a block
BITS, BLOCK = 62, 4096
#: a component's blocks: a sixteenth of it, within these
SMALLEST, PARTS = 64, 16
#: pairs a row, on average, that are looked at again one by one
PAIRS = 4
#: rows compared with a block at a time
STRIP = 256
#: more than what sums of rounded products are off by
ROUNDING = 2e-6


def passes_for(rows: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes until a pair at the threshold has been, with probability 1 - miss,
    within a window in one of them. Where planes split the table evenly those
    that agree in log2(rows / window) bits are, and a pair does with probability
    (1 - angle / pi) ** bits. Where vectors are all alike more bits are needed:
    the README has what is found there."""
    depth = max(1.0, math.log2(max(2, rows) / window))
    meet = (1 - math.acos(cosine) / math.pi) ** depth
    return max(4, math.ceil(math.log(miss) / math.log(1 - meet)))


def _planes(dim: int, passes: int) -> np.ndarray:
    return np.stack([np.random.default_rng([SEED, dim, p]).standard_normal((BITS, dim)) for p in range(passes)])


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Unit rows, in double precision, of vectors of one length."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, distance) of unit rows: scale times bytes is that far from the row."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    q = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    off = np.linalg.norm(x - q * scale[:, None].astype(np.float64), axis=1)
    return q, scale, (off * (1 + 1e-6)).astype(np.float32)


def _project(passes: int):
    """run, key, rep, sketch for each pass: run is the pass and the vector's length, key its bits."""

    def go(batches):
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            reps, vecs = batch.column(0), batch.column(1)
            dims = vecs.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = pa.array(np.flatnonzero(dims == dim))
                x = _matrix(vecs.take(rows))
                packed = np.hstack([part.reshape(len(x), -1).view(np.uint8) for part in sketch(x)])
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(x), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                for p, planes in enumerate(_planes(dim, passes)):
                    run = pa.array(np.full(len(x), (p << 32) + dim, np.int64))
                    yield pa.RecordBatch.from_arrays([run, pa.array((x @ planes.T > 0) @ powers), reps.take(rows), packed], ["run", "key", "rep", "sketch"])

    return go


def _cells(batches) -> Iterator[pa.RecordBatch]:
    """The rows of each cell (equal in the first two columns) of sorted batches."""
    held = None
    for batch in batches:
        if held is not None and len(held):
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ends = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()]
        for lo, hi in zip(ends, ends[1:], strict=False):
            yield batch.slice(lo, hi - lo)
        held = batch.slice(ends[-1])  # the next batch may go on with it
    if held is not None and len(held):
        yield held


def _sides(cell: pa.RecordBatch, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows to be compared with each other: those of two blocks, or twice those
    of one; None if there is nothing to compare."""
    block = cell.column(1)[0].as_py()
    if block >> 31 == block & (1 << 31) - 1:
        every = np.arange(len(tags))
        return (every, every) if len(tags) > 1 else None
    left, right = np.flatnonzero(tags & 1 == 0), np.flatnonzero(tags & 1)
    return (left, right) if len(left) and len(right) else None


def _unite(near: np.ndarray, left: np.ndarray, right: np.ndarray, links: UnionFind) -> None:
    """Link what is near, by a spanning forest: near copies have far more pairs than that."""
    label = np.arange(near.shape[1])
    for i in np.flatnonzero(near.any(axis=1)):
        met = np.unique(label[near[i]])
        for k in met:
            links.link(int(left[i]), int(right[k]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]


def _strips(carried: np.ndarray, width: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Rows of an ordered block, a strip at a time, those that follow them, and
    which of these are within `width` places: pairs of carried rows were compared
    in the block before."""
    n = len(carried)
    for lo in range(0, n - 1, STRIP):
        rows, after = slice(lo, min(n, lo + STRIP)), slice(lo + 1, min(n, lo + STRIP + width))
        gap = np.arange(after.start, after.stop)[None, :] - np.arange(rows.start, rows.stop)[:, None]
        compared = (gap >= 1) & (gap <= width) & ~(carried[rows, None] & carried[None, after])
        if compared.any():
            yield rows, after, compared


def _look(cell: pa.RecordBatch, cosine: float, links: UnionFind, pairs: int = PAIRS, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray] | None:
    """Unites what is certainly near within windows of an ordered block; the pairs
    that may be near, or None if they are too many. Columns: run, block, place, tag, sketch."""
    tags = cell.column(3).to_numpy()
    rep, carried = tags >> 1, (tags & 1).astype(bool)
    none = np.empty(0, np.int64)
    packed = np.frombuffer(b"".join(cell.column(4).to_pylist()), np.uint8).reshape(len(tags), -1)
    q = packed[:, :-8].view(np.int8).astype(np.float32)
    scale, off = (np.ascontiguousarray(packed[:, a:b]).view(np.float32)[:, 0].astype(np.float64) for a, b in ((-8, -4), (-4, packed.shape[1])))
    q *= scale[:, None].astype(np.float32)
    most = 2 * off.max() + off.max() ** 2 + ROUNDING
    found_a, found_b, total, limit = [], [], 0, pairs * len(tags)
    for rows, after, compared in _strips(carried, width):
        dots = q[rows] @ q[after].T
        at, to = np.nonzero((dots >= cosine - most) & compared)
        if not len(at):
            continue
        dot, a, b = dots[at, to], at + rows.start, to + after.start
        bound = off[a] + (1 + off[a]) * off[b] + ROUNDING
        sure = dot - bound >= cosine
        near = np.zeros(dots.shape, dtype=bool)
        near[at[sure], to[sure]] = True
        _unite(near, rep[rows], rep[after], links)
        perhaps = ~sure & (dot + bound >= cosine)
        if total > limit or not perhaps.any():
            continue
        a, b = rep[a[perhaps]], rep[b[perhaps]]
        ends, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.array([links.find(int(x)) if int(x) in links.up else int(x) for x in ends])[place]
        apart = root[: len(a)] != root[len(a) :]
        found_a.append(a[apart])
        found_b.append(b[apart])
        total += int(apart.sum())
    if total > limit:
        return None
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


LINK, PERHAPS, DENSE = 0, 1, 2
FOUND = "kind int, a long, b long, key long, block long"


def _found(kind: int, a, b, key=None, block=None) -> pa.RecordBatch:
    n = len(a)
    fill = lambda x: pa.array(np.full(n, x or 0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), fill(key), fill(block)], ["kind", "a", "b", "key", "block"])


def _forest(links: UnionFind) -> pa.RecordBatch:
    forest = links.forest()
    return _found(LINK, [a for a, _ in forest], [b for _, b in forest])


def _compare_sketches(cosine: float, most: int, width: int):
    """Rows: run, block, place, tag, sketch. A forest of the certain links of the
    partition; pairs that may be links; the rows of blocks with too many of these."""

    def go(batches):
        links = UnionFind()
        for cell in _cells(batches):
            pairs = _look(cell, cosine, links, most, width)
            if pairs is None:
                yield _found(DENSE, cell.column(3), cell.column(2), cell.column(0)[0].as_py(), cell.column(1)[0].as_py())
            elif len(pairs[0]):
                yield _found(PERHAPS, *pairs)
        yield _forest(links)

    return go


def _compare_vectors(cosine: float, width: int):
    """Rows: run, block, tag, vec, in their order. A forest of the links of the partition."""

    def go(batches):
        links = UnionFind()
        for cell in _cells(batches):
            tags, x = cell.column(2).to_numpy(), _matrix(cell.column(3))
            for rows, after, compared in _strips((tags & 1).astype(bool), width):
                _unite((x[rows] @ x[after].T >= cosine) & compared, tags[rows] >> 1, tags[after] >> 1, links)
        yield _forest(links)

    return go


def _verify(cosine: float):
    """Rows: a, b, u, v. The pairs whose vectors u, v are near."""

    def run(batches):
        for batch in batches:
            a, b, u, v = batch.columns
            dims = u.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                near = (_matrix(u.take(rows)) * _matrix(v.take(rows))).sum(axis=1) >= cosine
                yield _found(LINK, a.take(rows).to_numpy()[near], b.take(rows).to_numpy()[near])

    return run


def _count(cosine: float):
    """Rows: root, block, tag, n, vec. How many vectors each row has links to in its cell."""

    def run(batches):
        for cell in _cells(batches):
            tags, n = cell.column(2).to_numpy(), cell.column(3).to_numpy()
            sides = _sides(cell, tags)
            if sides is None:
                continue
            x, (left, right) = _matrix(cell.column(4)), sides
            same, counts = left is right, np.zeros(len(tags), np.int64)
            for k in range(0, len(left), STRIP):
                rows = left[k : k + STRIP]
                near = x[rows] @ x[right].T >= cosine
                if same:
                    near[np.arange(len(rows)), rows] = False
                else:
                    counts[right] += n[rows] @ near
                counts[rows] += near @ n[right]
            yield pa.RecordBatch.from_arrays([pa.array(tags >> 1), pa.array(counts)], ["rep", "links"])

    return run


def _in_cells(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Each row once for every block that its own is compared with: block names
    the two, tag is rep and the side. Sorted by cell, a cell in one partition."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    out = rows.withColumn("blocks", blocks.cast("long")).withColumn("own", block)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.shiftleft(F.least("own", "other"), 31) + F.greatest("own", "other")
    tag = F.shiftleft("rep", 1) + (F.col("own") > F.col("other")).cast("long")
    more = [c for c in rows.columns if c not in (key, "rep", "blocks")]
    cells = out.select(key, pair.alias("block"), tag.alias("tag"), *more)
    return cells.repartition(shuffle_partitions(rows.sparkSession), key, "block").sortWithinPartitions(key, "block")


def _in_order(few: DataFrame, passes: int, window: int) -> DataFrame:
    """run, block, place, tag, sketch: the rows of each pass in the order of their
    keys, cut into blocks; the last `window` rows of a block are in the next one too.

    A row's place is its number in its partition of the sorted table, plus what
    stands in the partitions before: a table of a row a partition and run."""
    parts = shuffle_partitions(few.sparkSession)
    keyed = few.mapInArrow(_project(passes), "run long, key long, rep long, sketch binary")
    ordered = keyed.repartitionByRange(parts, "run", "key", "rep").sortWithinPartitions("run", "key", "rep")
    ordered = materialize(ordered.select("run", "rep", "sketch", F.monotonically_increasing_id().alias("at")), "ordered").withColumn("part", F.shiftright("at", 33))
    before = F.coalesce(F.sum("n").over(W.partitionBy("run").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = ordered.groupBy("run", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    heads = materialize(heads.select("run", "part", (before - F.col("first")).alias("shift")), "heads")
    size = max(BLOCK, window)
    placed = ordered.join(heads, ["run", "part"]).withColumn("place", F.col("at") + F.col("shift"))
    block = F.floor(F.col("place") / size)
    own, carried = F.struct(block.alias("block"), F.lit(0).alias("carried")), F.struct((block + 1).alias("block"), F.lit(1).alias("carried"))
    both = F.when(F.col("place") % size >= size - window, F.array(own, carried)).otherwise(F.array(own))
    cells = placed.select("run", "place", "rep", "sketch", F.inline(both)).select("run", "block", "place", (F.shiftleft("rep", 1) + F.col("carried")).alias("tag"), "sketch")
    return cells.repartition(parts, "run", "block").sortWithinPartitions("run", "block", "place")


def _links(classes: DataFrame, cosine: float, window: int) -> DataFrame:
    """(a, b): links found, by rep, enough to join all that are."""
    passes = passes_for(classes.count(), cosine, window)
    few = classes.select("rep", "vec")
    found = materialize(_in_order(few, passes, window).mapInArrow(_compare_sketches(cosine, PAIRS, window), FOUND), "found")
    pairs = found.where(F.col("kind") == PERHAPS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda end, name: few.select(F.col("rep").alias(end), F.col("vec").alias(name))
    verified = pairs.join(of("a", "u"), "a").join(of("b", "v"), "b").select("a", "b", "u", "v").mapInArrow(_verify(cosine), FOUND)
    dense = found.where(F.col("kind") == DENSE).select("key", "block", F.col("a").alias("tag"), F.col("b").alias("place"), F.shiftright("a", 1).alias("rep"))
    dense = dense.join(few, "rep").repartition(shuffle_partitions(classes.sparkSession), "key", "block").sortWithinPartitions("key", "block", "place")
    compared = dense.select("key", "block", "tag", "vec").mapInArrow(_compare_vectors(cosine, window), FOUND)
    return found.where(F.col("kind") == LINK).unionByName(verified).unionByName(compared).select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing, itself included: no links, its own component. Vectors
    of different lengths never link. Equal vectors count as links of each other;
    rows that repeat an id count as one each; null ids stay, and name no
    component. An empty table gives an empty one; other columns aren't carried.
    """
    ids, given = column(vectors, id_col).cast("long"), column(vectors, vec_col)
    exact = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    wide = given.cast("array<double>")
    bad = F.coalesce(F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    valid = ~bad & F.exists(wide, lambda v: v != 0)
    digest = F.when(valid, F.sha2(F.array_join(F.transform(wide, lambda v: (v + F.lit(0.0)).cast("string")), ","), 256))
    rows = materialize(vectors.select(ids.alias("vec_id"), digest.alias("digest"), F.when(valid, given.cast(exact)).alias("vec")), "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec"))
    # numbered once: the table that is written is what later steps read, so a number names one class
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    roots = connected_components(_links(classes, cosine, window)).withColumnRenamed("id", "rep")
    linked = materialize(classes.select("rep", "first", "n", "vec").join(roots, "rep"), "linked")
    of = materialize(linked.groupBy("root").agg(F.count(F.lit(1)).alias("g"), F.min("first").alias("least")), "components")
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(SMALLEST), F.ceil(F.col("g") / PARTS)))
    blocks = linked.join(of.select("root", F.ceil(F.col("g") / size).alias("blocks")), "root").select("root", "rep", "n", "vec", "blocks")
    counts = _in_cells(blocks, "root", F.col("blocks")).mapInArrow(_count(cosine), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = linked.select("rep", "root").join(of.select("root", "least"), "root").join(counts, "rep", "left").select("rep", "least", "links")
    named = classes.select("digest", "rep", "n", "first").join(materialize(of_rep, "named"), "rep", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    whole = materialize(named.select("digest", links.alias("links"), F.coalesce("least", "first").alias("least")), "links")
    out = rows.select("vec_id", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("vec_id").cast("string"))).alias("digest")).join(whole, "digest", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
