"""A cache of functions and their vectors, kept up to date with a source tree.

The cache is a folder: tables of rows in windows (buckets of files, by the hash
of their path) and one manifest, which says what embedder and how many
components the vectors are of, and for each window where it is, how many rows it
has and their digest. A refresh embeds only files whose text has changed, writes
only windows that have changed, and then puts the new manifest in the old one's
place: readers see the old cache or the new one. A window that can't be read or
whose rows aren't those of the manifest is taken for lost, and made anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, WINDOWS, MANIFEST = 1, 64, "manifest.json"
#: a file's functions, from place 0, and one row for the file itself at place -1
ROWS = "path string, digest string, place int, name string, line int, tokens array<string>, vec array<float>"


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def load_manifest(root: str, embedder: str) -> dict | None:
    """The manifest, if it is one, of this format and embedder."""
    store, base = _store(root)
    try:
        with store.open_input_stream(f"{base}/{MANIFEST}") as f:
            got = json.loads(f.read())
    except (OSError, ValueError):
        return None
    if not isinstance(got, dict) or not isinstance(got.get("windows"), dict) or not isinstance(got.get("buckets"), int):
        return None
    return got if got.get("format") == FORMAT and got.get("embedder") == embedder and isinstance(got.get("dim"), int) else None


def _save_manifest(root: str, manifest: dict) -> None:
    store, base = _store(root)
    aside = f"{base}/{MANIFEST}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as f:
        f.write(json.dumps(manifest, sort_keys=True).encode())
    store.move(aside, f"{base}/{MANIFEST}")


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _digests(rows: DataFrame) -> DataFrame:
    """bucket, rows, digest, dims: the digest doesn't depend on the rows' order."""
    one = F.xxhash64("path", "digest", "place", "name", "line", "tokens", "vec").cast("decimal(38,0)")
    dims = F.array_sort(F.collect_set(F.size("vec")))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(one).cast("string").alias("digest"), F.filter(dims, lambda d: d >= 0).alias("dims"))


def _windows(spark: SparkSession, root: str, manifest: dict, wanted: list[str]) -> DataFrame:
    """The rows of some windows, each with its bucket."""
    store, base = _store(root)
    out = None
    for table in sorted({manifest["windows"][b]["table"] for b in wanted}):
        mine = [int(b) for b in wanted if manifest["windows"][b]["table"] == table]
        part = spark.read.schema(f"{ROWS}, bucket int").option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/bucket={b}" for b in mine])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"{ROWS}, bucket int") if out is None else out


def sound_windows(spark: SparkSession, root: str, manifest: dict) -> list[str]:
    """The windows whose rows are those of the manifest. All are read at once; if
    that fails, one by one, to find which can't be."""
    store, base = _store(root)
    there = [b for b, w in manifest["windows"].items() if store.get_file_info(f"{base}/{w['table']}/bucket={b}").type == pafs.FileType.Directory]

    def told(some: list[str]) -> dict:
        return {str(r.bucket): r for r in _digests(_windows(spark, root, manifest, some)).collect()} if some else {}  # a row a window

    try:
        seen = told(there)
    except Exception:  # noqa: BLE001  whatever a damaged table raises
        seen = {}
        for b in there:
            try:
                seen |= told([b])
            except Exception:  # noqa: BLE001, S110
                pass
    ok = lambda b, r: (r.rows, r.digest) == (manifest["windows"][b]["rows"], manifest["windows"][b]["digest"]) and set(r.dims) <= {manifest["dim"]}
    return sorted(b for b, r in seen.items() if ok(b, r))


def read_cache(spark: SparkSession, root: str, embedder: str) -> DataFrame | None:
    """path, name, line, tokens, vec of the functions in sound windows; None without a cache for this embedder."""
    manifest = load_manifest(root, embedder)
    if manifest is None:
        return None
    return _windows(spark, root, manifest, sound_windows(spark, root, manifest)).where("place >= 0").select("path", "name", "line", "tokens", "vec")


@dataclass
class Refreshed:
    """Files taken over, embedded and dropped, windows written."""

    reused: int
    embedded: int
    dropped: int
    windows: int


def refresh(files: DataFrame, root: str, embedder: str, embed: Callable[[DataFrame], DataFrame], buckets: int = WINDOWS) -> Refreshed:
    """Brings the cache up to files (path, text; null text as empty). embed turns files whose text is
    new into path, name, line, tokens, vec, a row a function in order of `place`.
    A file that comes twice counts once. All vectors have one length."""
    from ledgerline.plans.scratch import written

    spark = files.sparkSession
    store, base = _store(root)
    store.create_dir(base, recursive=True)
    manifest = load_manifest(root, embedder)
    buckets = manifest["buckets"] if manifest else buckets
    text = F.coalesce("text", F.lit(""))
    now = written(files.where("path is not null").groupBy("path").agg(F.max(text).alias("text")).select("path", "text", F.sha2("text", 256).alias("digest"), _bucket(F.col("path"), buckets).alias("bucket")))
    sound = sound_windows(spark, root, manifest) if manifest else []
    held = _windows(spark, root, manifest, sound) if sound else spark.createDataFrame([], f"{ROWS}, bucket int")
    known = held.where("place = -1").select("path", "digest")
    fresh = written(now.join(known, ["path", "digest"], "left_anti"))
    gone = known.join(now.select("path", "digest"), ["path", "digest"], "left_anti").withColumn("bucket", _bucket(F.col("path"), buckets))
    dirty = {r.bucket for r in fresh.select("bucket").unionByName(gone.select("bucket")).distinct().collect()}  # as many as windows
    dirty |= {int(b) for b in (manifest["windows"] if manifest else {}) if b not in sound}
    embedded, dropped = fresh.count(), gone.join(now.select("path"), "path", "left_anti").count()
    reused = now.count() - embedded
    if manifest and not dirty:
        return Refreshed(reused, 0, 0, 0)
    made = embed(fresh.select("path", "text")).select("path", "place", "name", "line", "tokens", F.col("vec").cast("array<float>").alias("vec")).join(fresh.select("path", "digest", "bucket"), "path")
    marks = fresh.select("path", "digest", "bucket").withColumns({"place": F.lit(-1), "name": F.lit(None).cast("string"), "line": F.lit(None).cast("int"), "tokens": F.lit(None).cast("array<string>"), "vec": F.lit(None).cast("array<float>")})
    kept = held.where(F.col("bucket").isin(*dirty) if dirty else F.lit(False)).join(now.select("path", "digest"), ["path", "digest"], "left_semi")
    order = ["path", "digest", "place", "name", "line", "tokens", "vec", "bucket"]
    whole = kept.select(*order).unionByName(made.select(*order)).unionByName(marks.select(*order))
    table = f"rows-{uuid.uuid4().hex[:12]}"
    whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{table}")
    new = {}
    dims = {manifest["dim"]} if manifest and sound and manifest["dim"] else set()
    if store.get_file_info(pafs.FileSelector(f"{base}/{table}", recursive=False)) and not whole.isEmpty():
        rows = spark.read.schema(f"{ROWS}, bucket int").parquet(f"{root}/{table}")
        for r in _digests(rows).collect():  # a row a window
            new[str(r.bucket)] = {"table": table, "rows": r.rows, "digest": r.digest}
            dims |= set(r.dims)
    if len(dims) > 1:
        store.delete_dir(f"{base}/{table}")
        raise ValueError(f"vectors of different lengths: {sorted(dims)}")
    old = {b: w for b, w in (manifest["windows"] if manifest else {}).items() if b in sound and int(b) not in dirty}
    _save_manifest(root, {"format": FORMAT, "embedder": embedder, "dim": next(iter(dims), 0), "buckets": buckets, "windows": old | new})
    return Refreshed(reused, embedded, dropped, len(new))


def vacuum(root: str, embedder: str) -> int:
    """Deletes tables that the manifest doesn't name any more; how many. Not while a refresh or a reader of an older manifest runs."""
    store, base = _store(root)
    manifest = load_manifest(root, embedder)
    named = {w["table"] for w in manifest["windows"].values()} if manifest else set()
    old = [i for i in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.type == pafs.FileType.Directory and i.base_name.startswith("rows-") and i.base_name not in named]
    for info in old:
        store.delete_dir(info.path)
    return len(old)
