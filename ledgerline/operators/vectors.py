"""Operators over vectors (array<float> or array<double>), in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Neighbours, distance and corpus size of the out-of-distribution test
NEIGHBOURS, FAR, LEAST_CORPUS = 3, 0.40, 5
#: Recall and confirm thresholds of duplicate search
RECALL, CONFIRM = 0.80, 0.97
#: A code before the edit shorter than this is a cold start
COLD_CHARS = 32
#: components that are summed as columns of their own; rows of a block of a search, at most and on small tables
SIDE_BY_SIDE, BLOCK, LEAST_BLOCK = 512, 50_000, 500
#: rows that the cells of a search are built around
PIVOTS = 64


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1.0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(dot(a, b) / n)


def cosine_unit(a: Column, b: Column) -> Column:
    """A zero vector counts as having norm 1, so its cosine is 0.0."""
    one = lambda x: F.when(norm(x) == 0, F.lit(1.0)).otherwise(norm(x))
    return dot(a, b) / (one(a) * one(b))


def chord(a: Column, b: Column) -> Column:
    """Distance of the unit vectors; 0 if both are zero, 2 if one is."""
    za, zb = norm(a) == 0, norm(b) == 0
    square = F.greatest(F.lit(0.0), 2 - 2 * cosine(a, b))
    return F.when(za & zb, F.lit(0.0)).when(za | zb, F.lit(2.0)).otherwise(F.sqrt(square))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def similarity_scores(cos: Column) -> tuple[Column, Column]:
    """(alignment, novelty)."""
    return clamp((cos + 1) / 2), clamp(1 - F.greatest(cos, F.lit(0.0)))


def dominant(v: Column) -> Column:
    """Place of the first greatest component, from 1; null for an empty vector."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)))


def _component_sums(df: DataFrame, by: list[str], vec: str, scale: Column, *aggs: Column) -> DataFrame:
    """by, the given aggregates, and __s: the sum of each component times scale, a row a group.
    Components are summed side by side, without a row each, up to SIDE_BY_SIDE of them."""
    dims = df.agg(F.max(F.size(vec))).first()[0] or 0
    if dims <= SIDE_BY_SIDE:
        side = [F.sum(F.get(vec, F.lit(i)).cast("double") * scale) for i in range(dims)]
        return df.groupBy(*by).agg(*aggs, F.filter(F.array(*side).cast("array<double>"), lambda x: x.isNotNull()).alias("__s"))
    each = df.select(*by, scale.alias("__k"), F.posexplode(vec).alias("__i", "__x")).groupBy(*by, "__i").agg(F.sum(F.col("__x").cast("double") * F.col("__k")).alias("__x"))
    listed = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda x: x["__x"]).alias("__s"))
    whole = df.groupBy(*by).agg(*aggs)
    return whole.join(listed, by) if by else whole.crossJoin(listed)  # a row each


def unit_sum(df: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """Mean pairwise cosine of a group in closed form, (|sum u|^2 - sum |u|^2) / (n (n - 1)):
    one pass, no pairs. Zero vectors count as having norm 1."""
    units = df.select(*by, vec, norm(F.col(vec)).alias("__l")).withColumn("__k", F.when(F.col("__l") == 0, F.lit(1.0)).otherwise(1 / F.col("__l")))
    own = F.sum(F.pow(F.col("__l") * F.col("__k"), 2)).alias("__own")
    sums = _component_sums(units, by, vec, F.col("__k"), F.count(F.lit(1)).alias("n"), own)
    pairs = F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    return sums.select(*by, "n", F.try_divide(dot(F.col("__s"), F.col("__s")) - F.col("__own"), pairs).alias("mean_cosine"))


def centroid(df: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """Mean vector of each group; its vectors have one length."""
    sums = _component_sums(df, by, vec, F.lit(1.0), F.count(vec).alias("__n"))
    return sums.select(*by, F.transform("__s", lambda x: x / F.col("__n")).alias("centroid"))


def drift_baseline(df: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """Per group its mean vector and the 95th percentile of the chords to it."""
    centres = centroid(df, by, vec)
    from ledgerline.operators.experiments import exact_quantiles
    from ledgerline.plans.scratch import cut

    far = cut(df.join(centres, by).select(*by, chord(F.col(vec), F.col("centroid")).alias("__d")))
    return exact_quantiles(far, by, "__d", {"p95": 0.95})


def drift(distance: Column, p95: Column) -> Column:
    """The chord as a share of the baseline's; itself where there is no baseline spread."""
    return clamp(F.when(p95 > 0, distance / p95).otherwise(distance))


def query_blocks(corpus: DataFrame, queries: DataFrame, keep, schema: str, strip: int = 2_000) -> DataFrame:
    """All of a stated query set against all corpus rows, in blocks: a task has
    one block of either, of BLOCK rows at most, and multiplies them a strip of
    queries at a time; `keep` turns a strip's cosines into result rows.

    corpus: id, vec; queries: qid, qvec. Both are counted first, so that blocks
    don't grow with the tables; on small tables there are as many as tasks.
    """
    tasks = max(1, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n, m = corpus.count(), queries.count()
    across = max(1, -(-n // max(1, min(BLOCK, max(LEAST_BLOCK, n // tasks)))))
    down = max(1, -(-m // BLOCK))
    dealt = lambda df, key, own, blocks, other, others: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    spread = dealt(corpus, "id", "__c", across, "__q", down)
    copies = dealt(queries, "qid", "__q", down, "__c", across)

    return spread.groupBy("__c", "__q").cogroup(copies.groupBy("__c", "__q")).applyInPandas(_meet(keep, strip), schema)


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1.0, size)


def _meet(keep, strip: int):
    """A block of the corpus with a block of queries, a strip of them at a time."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return keep(np.empty((0, 0)), right["qid"].to_numpy()[:0], left["id"].to_numpy()[:0])
        x, out = _unit(left["vec"]), []
        for k in range(0, len(right), strip):
            part = right.iloc[k : k + strip]
            out.append(keep(_unit(part["qvec"]) @ x.T, part["qid"].to_numpy(), left["id"].to_numpy()))
        return pd.concat(out)

    return run


def _chords(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def cells_by_pivots(corpus: DataFrame, queries: DataFrame, least: float, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries) dealt to cells, for cosines of `least` (above 0) or more:
    a row of the corpus (id, vec) to its nearest pivot's, a query (qid, qvec)
    to each cell that can hold a hit: by the triangle inequality its distance from
    the pivot is no more than the cell's radius and the distance that `least`
    stands for. Columns cell, block, part: cells of over BLOCK rows, and queries, are
    dealt on to blocks. Zero vectors are left out: their cosines are 0.

    Pivots are `pivots` rows of the corpus, chosen by hash; they and a radius for
    each are all that the driver holds."""
    from ledgerline.plans.scratch import written

    some = corpus.where(F.col("vec").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not some:
        return corpus.limit(0).withColumns({"cell": F.lit(0), "block": F.lit(0), "part": F.lit(0)}), queries.limit(0).withColumns({"cell": F.lit(0), "block": F.lit(0), "part": F.lit(0)})
    centres = _unit([r.vec for r in some])

    def assign(frames):
        for frame in frames:
            frame = frame[[np.any(v) for v in frame["vec"]]]
            far = _chords(_unit(frame["vec"]), centres) if len(frame) else np.empty((0, 1))
            yield frame.assign(cell=far.argmin(axis=1).astype("int32") if len(frame) else np.empty(0, "int32"), far=far.min(axis=1))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.select("id", "vec").schema)
    cells = written(corpus.where(F.col("vec").isNotNull()).select("id", "vec").mapInPandas(assign, f"{kinds}, cell int, far double"))
    told = {r.cell: (r.far, r.n) for r in cells.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(told)
    blocks = {c: -(-told[c][1] // BLOCK) for c in order}
    reach = np.array([told[c][0] for c in order]) + np.sqrt(2 - 2 * least) + 1e-9
    near = centres[order]
    parts = max(1, -(-queries.count() // BLOCK))

    def ask(frames):
        for frame in frames:
            frame = frame[[v is not None and np.any(v) for v in frame["qvec"]]]
            hit = _chords(_unit(frame["qvec"]), near) <= reach if len(frame) else np.empty((0, 1), bool)
            yield frame.assign(cell=[[order[j] for j in np.flatnonzero(h)] for h in hit]).explode("cell").dropna(subset=["cell"]).astype({"cell": "int32"})

    asked = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select("qid", "qvec").schema)
    wanted = queries.select("qid", "qvec").mapInPandas(ask, f"{asked}, cell int")
    count = F.create_map(*[F.lit(x) for c in order for x in (c, blocks[c])])
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = F.pmod(F.xxhash64("id"), F.element_at(count, F.col("cell"))).cast("int")
    left = cells.drop("far").withColumn("block", own).withColumn("part", upto(F.lit(parts)))
    right = wanted.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).withColumn("block", upto(F.element_at(count, F.col("cell"))))
    return left, right


def pairs_above(corpus: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """qid, id, cosine of each query's corpus rows with cosine `least` or more, itself
    left out. Above 0 only those cells meet that can hold a hit."""

    def keep(cos: np.ndarray, qids: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        q, i = np.nonzero(cos >= least) if cos.size else (np.empty(0, int), np.empty(0, int))
        out = pd.DataFrame({"qid": qids[q].astype("int64"), "id": ids[i].astype("int64"), "cosine": cos[q, i] if cos.size else np.empty(0)})
        return out[out["qid"] != out["id"]]

    schema = "qid long, id long, cosine double"
    if least <= 0:
        return query_blocks(corpus, queries, keep, schema)
    left, right = cells_by_pivots(corpus, queries, least)
    by = ["cell", "block", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_meet(keep, 2_000), schema)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Each query's k nearest corpus rows, itself left out: the best of each
    task first, then the best of those."""

    def keep(cos: np.ndarray, qids: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        if not cos.size:
            return pd.DataFrame({"qid": np.empty(0, "int64"), "id": np.empty(0, "int64"), "cosine": np.empty(0)})
        cos = np.where(qids[:, None] == ids[None, :], -2.0, cos)
        top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(qids)), top.shape[1])
        out = pd.DataFrame({"qid": qids[rows].astype("int64"), "id": ids[top.ravel()].astype("int64"), "cosine": cos[rows, top.ravel()]})
        return out[out["cosine"] > -2]

    found = query_blocks(corpus, queries, keep, "qid long, id long, cosine double")
    w = W.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def out_of_distribution(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean distance to the nearest rows, and whether that is far; unknown (null) in a corpus that is too small."""
    mean = nearest(corpus, queries).groupBy("qid").agg(F.avg(1 - F.col("cosine")).alias("distance"), F.count(F.lit(1)).alias("k"))
    enough = corpus.limit(LEAST_CORPUS).count() >= LEAST_CORPUS
    return mean.select("qid", "distance", F.when(F.lit(enough), F.col("distance") > FAR).alias("ood"))


def correlations(df: DataFrame, vec: str, dims: int, least: int = 3) -> DataFrame:
    """Pearson of each pair of the first `dims` components, nulls left out pair by
    pair; null below `least` rows or at zero variance. All moments in one pass."""
    pairs = [(i, j) for i in range(dims) for j in range(i + 1, dims)]

    def moments(i: int, j: int) -> Column:
        x, y = F.col(vec)[i].cast("double"), F.col(vec)[j].cast("double")
        both = x.isNotNull() & y.isNotNull()
        s = lambda v: F.sum(F.when(both, v))
        return F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.count(F.when(both, 1)).alias("n"), s(x).alias("x"), s(y).alias("y"), s(x * y).alias("xy"), s(x * x).alias("xx"), s(y * y).alias("yy"))

    one = df.agg(F.array(*[moments(*p) for p in pairs]).alias("m")).select(F.inline("m"))
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    spread = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    r = F.when((F.col("n") >= least) & (spread > 0), F.try_divide(cov, F.sqrt(F.greatest(spread, F.lit(0.0)))))
    return one.select("i", "j", "n", r.alias("r"))


def separation(values: DataFrame, group: str, value: str) -> DataFrame:
    """Cohen's d of two groups (True, False): pooled population deviation; 0 below 2 rows a group or without spread."""
    side = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    mean = lambda g: side(F.avg, F.lit(g))
    sd = F.sqrt((F.pow(side(F.stddev_pop, F.lit(True)), 2) + F.pow(side(F.stddev_pop, F.lit(False)), 2)) / 2)
    few = (side(F.count, F.lit(True)) < 2) | (side(F.count, F.lit(False)) < 2)
    return values.agg(F.when(few, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(mean(True) - mean(False), F.nullif(sd, F.lit(0.0))), F.lit(0.0))).alias("d"))
