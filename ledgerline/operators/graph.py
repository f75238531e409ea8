"""Operators over edge tables (src, dst) and imports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: distinct edges, greatest in and out degree, share of nodes without an edge."""
    ends = [F.struct(F.col(end).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("into")) for end, out in (("src", 1), ("dst", 0))]
    rows = edges.select("src", "dst").distinct().select(F.inline(F.array(*ends)))
    if nodes is not None:
        rows = rows.unionByName(nodes.select("node", F.lit(0).alias("out"), F.lit(0).alias("into")))
    per = rows.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(f"max_{c.removesuffix('to')}")
    one = per.agg(F.coalesce(F.sum("out"), F.lit(0)).alias("n_edges"), most("into"), most("out"), F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("out") + F.col("into") == 0, 1)).alias("__alone"))
    return one.withColumn("isolated_share", F.coalesce(F.try_divide("__alone", F.nullif("n_nodes", F.lit(0))), F.lit(0.0))).drop("__alone")


def importers(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """How many files import each known module (file, name; module)."""
    known = imports.join(modules.select(F.col("module").alias("name")), "name")
    counts = known.groupBy("name").agg(F.countDistinct("file").alias("n_files"))
    return modules.join(counts.withColumnRenamed("name", "module"), "module", "left").select("module", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def fan_in(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 20)


def coupling(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 40)


def _components(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Strongly connected component of both ends of each edge, as (edges, 2);
    one depth-first pass with an explicit stack, linear in the edges."""
    codes = pd.factorize(np.concatenate([src, dst]))[0]
    s, d = codes[: len(src)], codes[len(src) :]
    n = int(codes.max(initial=-1)) + 1
    order = np.argsort(s, kind="stable")
    heads, start = d[order].tolist(), np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))]).tolist()
    seen, low, component = [0] * n, [0] * n, [-1] * n
    at, waiting, clock, found = start[:n], [], 0, 0
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                waiting.append(v)
            if at[v] < start[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif component[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path and component[v] < 0:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                while component[v] < 0:
                    component[waiting.pop()] = found
                found += 1
    both = np.array(component, dtype=np.int64)
    return np.stack([both[s], both[d]], axis=1) if len(s) else np.empty((0, 2), np.int64)


def _trim(edges: DataFrame, cut) -> DataFrame:
    """Without the edges from nodes that nothing enters and to nodes that nothing leaves: one round of it."""
    kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return cut(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def _colours(edges: DataFrame, cut) -> DataFrame:
    """node, colour: the greatest node that reaches it."""
    now = cut(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
    while True:
        told = edges.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("told"))
        after = now.join(told, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", F.coalesce("told", "colour")).alias("colour"), (F.col("told") > F.col("colour")).alias("moved"))
        after = cut(after)
        done = after.where("moved").isEmpty()
        now = after.select("node", "colour")
        if done:
            return now


def _back(edges: DataFrame, cut) -> DataFrame:
    """node, colour of the nodes that reach the one their colour names, over edges (src, dst, colour) within colours."""
    known = cut(edges.select(F.col("dst").alias("node"), "colour").where("node = colour").distinct())
    fresh = known
    while not fresh.isEmpty():
        reached = edges.join(fresh.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
        fresh = cut(reached.join(known, ["node", "colour"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def on_cycles(edges: DataFrame, at_once: int = 1_000_000) -> DataFrame:
    """The distinct edges (src, dst) that lie on some cycle: those within a
    strongly connected component, and loops. Edges with a null end lie on none.

    While more than `at_once` edges are left: what no cycle can pass is trimmed
    off, each node is coloured with the greatest node that reaches it, and of a
    colour the nodes that reach that one in turn are a component; edges between
    colours or out of components go, the others go round again. Rounds grow with
    the paths' lengths. `at_once` edges or fewer are split by one task, in time
    linear in them.
    """
    from ledgerline.plans.scratch import cut

    whole = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    out = whole.where("src = dst")
    now = whole.where("src <> dst")
    while (n := now.count()) > at_once:
        now = _trim(now, cut)
        if now.count() == n or at_once == 0:
            colour = _colours(now, cut)
            of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
            same = now.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour")
            same = cut(same.select("src", "dst", F.col("src_colour").alias("colour")))
            component = _back(same, cut).select("node").withColumn("marked", F.lit(True))
            marked = lambda end: component.select(F.col("node").alias(end), F.col("marked").alias(f"{end}_in"))  # noqa: B023, E731
            split = cut(same.join(marked("src"), "src", "left").join(marked("dst"), "dst", "left").select("src", "dst", "src_in", "dst_in"))
            out = out.unionByName(split.where("src_in and dst_in").select("src", "dst"))
            now = cut(split.where("src_in is null and dst_in is null").select("src", "dst"))

    def finish(frames):
        every = pd.concat(frames, ignore_index=True)
        ends = _components(every["src"].to_numpy(), every["dst"].to_numpy())
        yield every[ends[:, 0] == ends[:, 1]]

    return out.unionByName(now.coalesce(1).mapInPandas(finish, now.schema)) if n else out


def new_edges(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed): distinct rows of one side alone; nulls equal each other. One grouping of both sides."""
    side = lambda df, was: df.withColumns({"__was": F.lit(was), "__is": F.lit(1 - was)})
    both = side(before, 1).unionByName(side(after, 0)).groupBy(*before.columns).agg(F.max("__was").alias("__was"), F.max("__is").alias("__is"))
    only = lambda c: both.where(F.col(c) == 0).select(*before.columns)
    return only("__was"), only("__is")
