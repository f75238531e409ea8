"""Which commits lie between two heads of a commit graph, for many heads at once.

Commits are cut into chains: each follows its first parent, and of several that
follow the same one the newest goes on with its chain (where branches are merged,
that is the main line, which most ranges run along). What a head reaches on a
chain is everything up to some place, so that a set of commits is a row per
chain. Heads are walked chain by chain, not commit by commit: a round crosses
from all reached chains to the next ones, and a history without branches takes
none. Corrected dates, later than those of all parents, bound the walks at the
older head, whatever the clocks said; edges are found by their day. A newer head
is walked once for all older ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: seconds of a bucket in which edges are looked up; places of a chain that one task looks at, and of a piece in which commits are looked up
BUCKET, PLACES, PIECE = 86_400, 4096, 32
#: seconds of commits whose links are followed together; the most of them at a time
SPAN, CHUNK = 64 * 86_400, 200_000
#: Fixed value: what the link of a decision with a commit rests on
EXACT = "exact_head_range"


def _bucket(key: Column | str) -> Column:
    return F.floor((F.col(key) if isinstance(key, str) else key) / BUCKET)


def _near(batches):
    """Each row's way along its links as far as the rows at hand tell, CHUNK of
    them at a time: (project, sha, ts, far, place), far is null at a chain's start."""
    kept: list = []

    def walked():
        rows = pa.Table.from_batches(kept)
        project, sha, far = (rows.column(c).to_pandas() for c in ("project", "sha", "far"))
        here = pd.MultiIndex.from_arrays([project, sha])
        linked = far.notna().to_numpy()
        at = np.where(linked, here.get_indexer(pd.MultiIndex.from_arrays([project, far])), -1)
        place, last = (at >= 0).astype("int64"), np.where(at >= 0, at, np.arange(len(at)))
        while (at >= 0).any():  # twice as far each time
            on = at >= 0
            place = np.where(on, place + place[last], place)
            last, at = last[last], np.where(on, at[last], -1)
        ends = far.to_numpy(dtype=object)[last]
        out = linked[last]  # on from what isn't here
        ends = np.where(out, ends, sha.to_numpy(dtype=object)[last])
        return pa.RecordBatch.from_arrays([rows.column("project").combine_chunks(), rows.column("sha").combine_chunks(), rows.column("ts").combine_chunks(), pa.array(ends, pa.string()), pa.array(place + out), pa.array(~out)], names=["project", "sha", "ts", "far", "place", "done"])

    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= CHUNK:
            yield walked()
            kept.clear()
    if kept:
        yield walked()


def _chains(commits: DataFrame, every: DataFrame, cut) -> DataFrame:
    """project, sha, ts, chain, place: chain is its first commit's sha.

    Commits of one time are dealt together and most links end there. Only what
    the links point to elsewhere is followed further: pointers jump twice as far
    each round."""
    key = ["project", "sha"]
    goes_on = every.where("nth = 0").groupBy("project", "parent").agg(F.max_by("sha", F.struct("ts", "sha")).alias("sha"))
    links = goes_on.select("project", "sha", F.col("parent").alias("far"))
    started = commits.select("project", "sha", "ts").join(links, key, "left").withColumn("span", F.floor(F.col("ts") / SPAN))
    dealt = started.hint("rebalance", "project", "span").select("project", "sha", "ts", "far")
    near = cut(dealt.mapInArrow(_near, "project string, sha string, ts long, far string, place long, done boolean"))
    open_ = near.where("not done")
    if open_.isEmpty():
        return near.select("project", "sha", "ts", F.col("far").alias("chain"), "place")
    asked = open_.select("project", F.col("far").alias("sha")).distinct()
    now = cut(near.join(asked, key, "left_semi").select("project", "sha", "far", "place", "done"))
    while not now.where("not done").isEmpty():
        ahead = now.select("project", F.col("sha").alias("far"), F.col("far").alias("next"), F.col("place").alias("more"), F.col("done").alias("last"))
        moved = now.where("not done").join(ahead, ["project", "far"]).select("project", "sha", F.col("next").alias("far"), (F.col("place") + F.col("more")).alias("place"), F.col("last").alias("done"))
        now = cut(now.where("done").unionByName(moved))
    ahead = now.select("project", F.col("sha").alias("far"), F.col("far").alias("chain"), F.col("place").alias("more"))
    moved = open_.join(ahead, ["project", "far"]).select("project", "sha", "ts", "chain", (F.col("place") + F.col("more")).alias("place"))
    return near.where("done").select("project", "sha", "ts", F.col("far").alias("chain"), "place").unionByName(moved)


def _along(nodes: DataFrame, *more: str) -> DataFrame:
    """Dates that grow by a second at least along each chain; a task looks at PLACES of it."""
    part = F.floor(F.col("place") / PLACES)
    rows = nodes.withColumns({"part": part, "over": F.col("date") - F.col("place")})
    before = W.partitionBy("project", "chain").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("project", "chain", "part").agg(F.max("over").alias("top")).select("project", "chain", "part", F.max("top").over(before).alias("top"))
    within = W.partitionBy("project", "chain", "part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("over", F.max("over").over(within)).join(parts, ["project", "chain", "part"])
    return rows.select("project", "sha", "ts", "chain", "place", *more, (F.col("place") + F.greatest("over", F.coalesce("top", "over"))).alias("date"))


def once(commits: DataFrame) -> DataFrame:
    """One row a commit: repeated ones count once, with all their files."""
    found = {"ts": F.coalesce(F.min("ts").cast("long"), F.lit(0)), "parents": F.max("parents")}
    if "files" in commits.columns:
        found |= {"files": F.array_distinct(F.flatten(F.collect_list("files"))), "message": F.max("message")}
    return commits.where("project is not null and sha is not null").groupBy("project", "sha").agg(*[c.alias(k) for k, c in found.items()])


def label_commits(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of commits (project, sha, parents, ts in seconds): project,
    sha, ts, chain, place, date, no (a number of its own); and the edges that lead
    from one chain to another, with c_ and p_ for child and parent. Parents that
    aren't there (a shallow history) are passed over, repeated commits and parents
    count once. The graph has no cycles, as commits have none.

    Dates are corrected until no commit is as old as a parent: along chains at
    once, across them a round at a time, so that rounds grow with the chains
    that a wrong clock spans. A round takes only the chains with a wrong date.
    """
    from ledgerline.plans.scratch import written as cut

    return _label(cut(once(commits.select("project", "sha", "parents", "ts"))), cut)


def _label(commits: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    key = ["project", "sha"]
    there = commits.select("project", F.col("sha").alias("parent"))
    every = cut(commits.select(*key, "ts", F.posexplode(F.array_distinct("parents")).alias("nth", "parent")).join(there, ["project", "parent"]).where("parent <> sha"))
    nodes = cut(_along(_chains(commits, every, cut).withColumn("date", F.col("ts"))).withColumn("no", F.monotonically_increasing_id()))
    of = lambda df, end, name: df.select("project", F.col("sha").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in ("chain", "place", "date")])
    across = every.select(*key, "parent").join(of(nodes, "sha", "c"), key).join(of(nodes, "parent", "p"), ["project", "parent"])
    edges = cut(across.where("not (c_chain = p_chain and c_place = p_place + 1)"))
    while True:
        late = cut(edges.where("c_date <= p_date").groupBy("project", "sha", F.col("c_chain").alias("chain")).agg((F.max("p_date") + 1).alias("least")))
        if late.isEmpty():
            return nodes, edges
        wrong = nodes.join(late.select("project", "chain").distinct(), ["project", "chain"], "left_semi").join(late.drop("chain"), key, "left")
        dated = _along(wrong.withColumns({"was": F.col("date"), "date": F.greatest("date", F.coalesce("least", "date"))}), "was")
        moved = cut(dated.where("date > was").select(*key, "date"))
        newer = lambda df, end, name: df.join(moved.select("project", F.col("sha").alias(end), F.col("date").alias("newer")), ["project", end], "left").withColumn(name, F.coalesce("newer", name)).drop("newer")
        nodes = cut(newer(nodes, "sha", "date"))
        edges = cut(newer(newer(edges, "sha", "c_date"), "parent", "p_date"))


def _down(tops: DataFrame, edges: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """How far up each chain the heads (head, project, chain, place, date, bound) reach, over edges to
    dates from their bound on: head, chain, highest; and the edges they meet, with head."""
    key = ["head", "project", "chain", "bound"]
    best = cut(tops.select(*key, "place", "date", F.lit(None).cast("long").alias("before")))
    fresh, seen = best, edges.where("false").select(F.lit(0).cast("long").alias("head"), "c_chain", "c_place", "p_chain", "p_place")
    by_day = edges.select("project", F.col("c_chain").alias("chain"), _bucket("c_date").alias("day"), "c_place", "p_chain", "p_place", "p_date")
    while not fresh.isEmpty():
        days = fresh.withColumn("day", F.explode(F.sequence(_bucket("bound"), _bucket("date"))))
        met = days.join(by_day, ["project", "chain", "day"]).where((F.col("c_place") <= F.col("place")) & (F.col("before").isNull() | (F.col("c_place") > F.col("before"))) & (F.col("p_date") >= F.col("bound")))
        met = cut(met.select("head", "project", "bound", "chain", "c_place", "p_chain", "p_place", "p_date"))
        seen = seen.unionByName(met.select("head", F.col("chain").alias("c_chain"), "c_place", "p_chain", "p_place"))
        gone = met.select("head", "project", F.col("p_chain").alias("chain"), "bound", F.col("p_place").alias("place"), F.col("p_date").alias("date"), F.lit(None).cast("long").alias("known"))
        known = best.select(*key, "place", "date").withColumn("known", F.col("place"))
        best = cut(known.unionByName(gone).groupBy(*key).agg(F.max("place").alias("place"), F.max("date").alias("date"), F.max("known").alias("before")))
        fresh = best.where("before is null or place > before")
    return best.select("head", "chain", F.col("place").alias("highest")), seen


def _up(start: DataFrame, edges: DataFrame, cut) -> DataFrame:
    """pair, head, chain, lowest: from where on each chain of a head's history the commits
    descend from the starts (pair, head, chain, lowest); edges: those of the heads."""
    key = ["pair", "head", "chain"]
    best = cut(start.select(*key, "lowest", F.lit(None).cast("long").alias("before")))
    fresh = best
    while not fresh.isEmpty():
        met = fresh.join(edges.withColumnRenamed("p_chain", "chain"), ["head", "chain"]).where((F.col("p_place") >= F.col("lowest")) & (F.col("before").isNull() | (F.col("p_place") < F.col("before"))))
        met = met.select("pair", "head", F.col("c_chain").alias("chain"), F.col("c_place").alias("lowest"), F.lit(None).cast("long").alias("known"))
        after = best.select(*key, "lowest", F.col("lowest").alias("known")).unionByName(met).groupBy(*key)
        best = cut(after.agg(F.min("lowest").alias("lowest"), F.min("known").alias("before")))
        fresh = best.where("before is null or lowest < before")
    return best.select(*key, "lowest")


def head_ranges(nodes: DataFrame, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """project, before, after, chain, lowest, highest: where on each chain the
    commits lie that descend from `before` and that `after` reaches, itself included.
    heads: project, before, after; those that are equal, null, unknown or don't
    descend from each other have no range.

    The way down is walked once a newer head, as far as its oldest partner; the
    way up only over edges that were met there."""
    from ledgerline.plans.scratch import written as cut

    of = lambda end, name: nodes.select("project", F.col("sha").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in ("chain", "place", "date", "no")])
    heads = heads.select("project", "before", "after").where("before <> after").distinct()
    heads = heads.join(of("before", "b"), ["project", "before"]).join(of("after", "a"), ["project", "after"]).where("b_date < a_date")
    heads = cut(heads.withColumn("pair", F.monotonically_increasing_id()))
    tops = heads.groupBy("project", F.col("a_no").alias("head"), F.col("a_chain").alias("chain"), F.col("a_place").alias("place"), F.col("a_date").alias("date")).agg(F.min("b_date").alias("bound"))
    highest, met = _down(tops, edges, cut)
    start = heads.select("pair", F.col("a_no").alias("head"), F.col("b_chain").alias("chain"), F.col("b_place").alias("lowest"))
    within = lambda df: df.join(highest, ["head", "chain"]).where("lowest <= highest")
    # a start that its head doesn't reach has no way up
    found = within(_up(within(start).drop("highest"), met, cut))
    return found.select("pair", "chain", "lowest", "highest").join(heads.select("pair", "project", "before", "after"), "pair").drop("pair")


def _within(ranges: DataFrame, placed: DataFrame, more: list[str]) -> DataFrame:
    """The placed commits (project, chain, place, sha) of each range, but the older head."""
    piece = lambda place: F.floor(F.col(place) / PIECE)
    pieces = ranges.withColumn("piece", F.explode(F.sequence(piece("lowest"), piece("highest"))))
    joined = pieces.join(placed.withColumn("piece", piece("place")), ["project", "chain", "piece", *more])
    return joined.where((F.col("place") >= F.col("lowest")) & (F.col("place") <= F.col("highest")) & (F.col("sha") != F.col("before")))


def commits_between(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """project, before, after, sha: the commits on the paths from each older head to the newer one."""
    nodes, edges = label_commits(commits)
    return _within(head_ranges(nodes, edges, heads), nodes.select("project", "chain", "place", "sha"), []).select("project", "before", "after", "sha")


def linked_commits(decisions: DataFrame, commits: DataFrame) -> DataFrame:
    """decision_id, sha, ts, message, link_confidence: the commits of a decision's
    head range that touch its file.

    decisions: decision_id, project, git_head_before, git_head_after (the
    session's), file_path_rel; commits: project, sha, parents, ts, message,
    files. Nulls link nothing. A decision's ranges are joined with the commits
    by project, chain, file and piece of the chain, so that a file that is touched
    all the time is no hot key.
    """
    from ledgerline.plans.scratch import written as cut

    commits = cut(once(commits.select("project", "sha", "parents", "ts", "message", "files")))
    nodes, edges = _label(commits, cut)
    asked = decisions.select("decision_id", "project", F.col("git_head_before").alias("before"), F.col("git_head_after").alias("after"), F.col("file_path_rel").alias("file"))
    asked = cut(asked.where("before <> '' and after <> '' and file is not null").distinct())
    ranges = cut(head_ranges(nodes, edges, asked))
    told = commits.where("size(files) > 0").select("project", "sha", "files", "message").join(nodes.select("project", "sha", "ts", "chain", "place"), ["project", "sha"])
    placed = told.select("project", "chain", "place", "sha", "ts", "message", F.explode("files").alias("file"))
    out = _within(asked.join(ranges, ["project", "before", "after"]), placed, ["file"])
    return out.select("decision_id", "sha", "ts", "message", F.lit(EXACT).alias("link_confidence"))
