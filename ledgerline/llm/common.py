"""Shared plumbing of the training-data operators: shared scratch tables, and
connected components over edge tables of any size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary
    folder of this process, removed at its end, only where that is unset and the
    master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return _OWN_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/ledgerline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def column(df: DataFrame, name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def carried(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a working column's; doc.* gives them back."""
    return F.struct(*[column(df, c) for c in df.columns]).alias("doc")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back. Cuts the
    lineage, survives lost executors, and leaves later joins free to exchange
    (so that adaptive execution may split hot keys on either side)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph with edges (a, b), longs without nulls.

    Returns (id, root) for every vertex that has an edge to another; root is
    some vertex of the component, the same for all of its vertices. Loops and
    repeated edges do no harm; no edges give an empty table.

    Rounds of contraction: each vertex picks the neighbour (or itself) with the
    smallest hash of that round, edges are renamed and deduplicated, until none
    is left; then the choices are composed. A round removes a constant share of
    the vertices on average, so rounds grow with the logarithm of the input.
    Each round reads and writes tables, so a hot vertex is a hot join key with
    an exchange on both sides, which adaptive execution splits.
    """
    flow = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    steps: list[DataFrame] = []
    while True:
        if steps and flow.isEmpty():
            break
        seed = F.lit(len(steps))
        order = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("r"))
        both = flow.unionByName(flow.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = (
            both.groupBy("a")
            .agg(F.min(order("b")).alias("best"))
            .select(F.col("a").alias("id"), F.least(order("a"), "best")["r"].alias("r"))
        )
        step = materialize(step, "step")
        steps.append(step)
        to = lambda end: step.select(F.col("id").alias(end), F.col("r").alias(f"r{end}"))  # noqa: E731, B023
        left, right = F.least("ra", "rb"), F.greatest("ra", "rb")
        flow = materialize(
            flow.join(to("a"), "a").join(to("b"), "b").where("ra <> rb").select(left.alias("a"), right.alias("b")).distinct(),
            "edges",
        )
    roots = steps[0]
    for step in steps[1:]:
        after = step.select(F.col("id").alias("r"), F.col("r").alias("next"))
        roots = materialize(roots.join(after, "r", "left").select("id", F.coalesce("next", "r").alias("r")), "roots")
    return roots.select("id", F.col("r").alias("root"))


class UnionFind:
    """Links seen by one task; memory grows with the linked vertices only."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (parent := up.setdefault(root, root)) != root:
            root = parent
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def link(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def forest(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
