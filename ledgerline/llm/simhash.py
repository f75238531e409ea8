"""SimHash near-duplicates by anchor points.

Fingerprints of 64 bits within 2 bits of each other are linked. The anchors are
a covering code: the perfect Hamming code [63, 57] on the low 63 bits, times
both values of the top bit. Every 64-bit string is within R = 1 of an anchor.
Two fingerprints x, y within t = 2 have a string m between them, within t/2 = 1
of either, and m's nearest anchor is within R + t/2 = 2 of both; so each
fingerprint is replicated to every anchor within that radius (33 at most), and
fingerprints are compared per anchor. Splitting the threshold over both sides
covers what R + t on one side would, with a twentieth of the replicas. The
anchors number 2**58, so strangers rarely meet, and at most 2,081 different
fingerprints share an anchor, however large a group of near copies is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, carried, column, connected_components, materialize, shuffle_partitions

SEED, SHINGLE, THRESHOLD = 42, 3, 2
_LOW = np.uint64(0x0101010101010101)


def _majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes (1 at least), the bits set in over half of
    them: per bit plane the eight byte lanes of a word are summed at once, over
    pieces of 255 words at most so that no lane overflows."""
    ends = np.cumsum(sizes)
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(ends - sizes - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    prints = np.zeros(len(sizes), dtype=np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LOW, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)  # lane j holds bit 8 j + k
        for j in range(8):
            prints |= (2 * counts[:, j] > sizes).astype(np.uint64) << np.uint64(8 * j + k)
    return prints


def _shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    return [hash_of(join(x), SEED) for x in zip(words, words[1:], words[2:])]  # noqa: B905  SHINGLE words each


def fingerprint_all(texts: list[str | None], at_once: int = 500_000) -> np.ndarray:
    """Unsigned fingerprints; words are split by the six ASCII white-space
    characters, A-Z lower-cased; texts are taken together until they have
    at_once shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        found = _shingle_hashes(text)
        if found:
            held.append(np.array(found, dtype=np.uint64))
            rows.append(i)
            total += len(found)
        if total >= at_once:
            out[rows] = _majorities(np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held)))
            held, rows, total = [], [], 0
    if rows:
        out[rows] = _majorities(np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held)))
    return out


def fingerprint(text: str | None) -> int:
    return int(fingerprint_all([text])[0])


def _fingerprints(batches):
    for batch in batches:
        prints = fingerprint_all(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["doc_id", "fp", "row"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, fp, row), fp as a signed long; one row per input row. row: a
    hash that tells rows of one id apart, null if not given."""
    few = docs.select(
        column(docs, id_col).cast("long").alias("doc_id"),
        column(docs, text_col).cast("string").alias("text"),
        (F.lit(None) if row is None else row).cast("long").alias("row"),
    )
    return few.mapInArrow(_fingerprints, "doc_id long, fp long, row long")


#: parity masks of the Hamming code: bit b of the syndrome is the parity of the positions p (1 to 63) with bit b set
_MASKS = [np.uint64(sum(1 << (p - 1) for p in range(1, 64) if p >> b & 1)) for b in range(6)]
_TOP = np.uint64(1 << 63)


def _flips() -> np.ndarray:
    """For each syndrome: what turns a string into each anchor within radius 2; padded with repeats."""
    one = [np.uint64(0), *(np.uint64(1 << (p - 1)) for p in range(1, 64))]
    rows = []
    for s in range(64):
        pairs = [one[i] | one[i ^ s] for i in range(1, 64) if i < i ^ s] if s else []
        found = list(dict.fromkeys([one[s], *pairs, one[s] | _TOP]))
        rows.append(found + found[:1] * (33 - len(found)))
    return np.array(rows, dtype=np.uint64)


_FLIPS = _flips()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) pairs of unsigned fingerprints, each pair once."""
    syndrome = np.zeros(len(fps), dtype=np.int64)
    for b, mask in enumerate(_MASKS):
        syndrome |= (np.bitwise_count(fps & mask) & 1).astype(np.int64) << b
    found = fps[:, None] ^ _FLIPS[syndrome]
    own = np.ones(found.shape, dtype=bool)
    own[syndrome == 0, 2:] = False
    return found[own], np.repeat(fps, own.sum(axis=1))


def _replicate(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for i in range(0, len(fps), 20_000):
            at, fp = anchors(fps[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fp.view(np.int64))], ["anchor", "fp"])


def _compare(batches):
    """Rows sorted by anchor; a forest of the links found in this partition."""
    links = UnionFind()

    def group(members: np.ndarray) -> None:
        for i in range(len(members) - 1):
            near = np.bitwise_count(members[i + 1 :] ^ members[i]) <= THRESHOLD
            for y in members[i + 1 :][near].view(np.int64).tolist():
                links.link(int(members[i].view(np.int64)), y)

    held_at, held = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        at = np.concatenate([held_at, batch.column(0).to_numpy()])
        fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
        if not len(at):
            continue
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        open_ = int(cuts[-1]) if len(cuts) else 0  # the last anchor may go on in the next batch
        held_at, held = at[open_:], fps[open_:]
        starts = np.concatenate([[0], cuts])[: len(cuts)]
        sizes = np.diff(np.concatenate([starts, [open_]]))
        two = starts[sizes == 2]
        for i in two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= THRESHOLD].tolist():
            links.link(int(fps[i].view(np.int64)), int(fps[i + 1].view(np.int64)))
        for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group(fps[i : i + n])
    group(held)
    forest = links.forest()
    a, b = zip(*forest, strict=True) if forest else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, row, fingerprint, root, component_id), one row per input row.

    component_id is the smallest id reachable by links, itself included; root
    names the component by one of its fingerprints. Null and empty texts have
    fingerprint zero, linked like any other. Rows with a null id take part but
    never name a component (null only where no id is known). Repeated rows give
    repeated results; an empty table an empty one; other columns aren't carried.

    Equal fingerprints are first reduced to one (with their smallest id), so
    copies cost nothing further; comparisons, components and the way back are
    joins of tables, in which adaptive execution splits hot fingerprints.
    """
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, id_col, text_col, row), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    n = shuffle_partitions(spark)
    shared = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long").repartition(n, "anchor").sortWithinPartitions("anchor")
    roots = connected_components(shared.mapInArrow(_compare, "a long, b long")).withColumnRenamed("id", "fp")
    named = materialize(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of = materialize(named.select("fp", "root").join(least, "root"), "components")
    return prints.join(of, "fp").select(
        "doc_id", "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id"
    )


def _hash_of(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which Spark doesn't hash, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(column(docs, f.name))) if "map<" in f.dataType.simpleString() else column(docs, f.name) for f in docs.schema])


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of docs (doc_id, text, ...), whatever their names, and one row
    of each component: the one with the smallest id (null ids last), of rows
    with that id the one with the smallest hash, of equal rows one. Null and
    empty texts are one component; an empty table gives an empty one."""
    row = _hash_of(docs)
    marks = near_duplicates(docs, row=row)
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    kept = materialize(marks.groupBy("root").agg(F.min(order).alias("kept")).select("kept.*"), "kept")
    doc_id = column(docs, "doc_id").cast("long")
    keyed = docs.select(carried(docs), doc_id.isNull().alias("late"), F.coalesce(doc_id, F.lit(0)).alias("id"), row.alias("row"))
    on = ["late", "id", "row"]
    return keyed.join(kept, on, "left_semi").dropDuplicates(on).select("doc.*")
