"""Bootstrap intervals, for groups of any size.

A resample of n values is drawn as counts: how many of its draws fall on each
piece of the distinct values (multinomial, by the rows in the piece), then how
many of a piece's draws on each of its values. Every task that has a piece draws
the first from the same seed, so that pieces need not meet; a task holds one piece
and makes the resamples a block at a time. Where hardly a value comes twice it
draws the values themselves: the same law, at less cost. What is summed over the
pieces is one number a resample. Moments that the interval's correction takes are aggregates.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.experiments import holm, wilcoxon

#: distinct values of a piece, resamples of a block, numbers that a task holds of a block
PIECE, BLOCK, ENTRIES = 50_000, 500, 5_000_000
#: Resamples and seed of the interval of a mean
RESAMPLES, SEED = 10_000, 42


def _pieces(rows: DataFrame, by: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(grp, piece, x, n): distinct values with their counts, dealt to pieces by their hash; and
    (of, at, other, k): beside each piece the rows of all the group's pieces. Values that are null or no number are left out."""
    from ledgerline.plans.scratch import cut

    kept = rows.select(F.col(by).alias("grp"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counts = cut(kept.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces")).withColumnRenamed("grp", "g")
    dealt = cut(counts.join(sizes, F.col("grp").eqNullSafe(F.col("g"))).withColumn("piece", F.pmod(F.xxhash64("x"), F.col("pieces"))).drop("g", "pieces"))
    held = cut(dealt.groupBy("grp", "piece").agg(F.sum("n").alias("k")))
    others = held.select(F.col("grp").alias("g"), F.col("piece").alias("other"), "k")
    return dealt, held.select(F.col("grp").alias("of"), F.col("piece").alias("at")).join(others, F.col("of").eqNullSafe(F.col("g"))).drop("g")


def _sums(rng: np.random.Generator, x: np.ndarray, n: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Sums of so many draws each from the values x, n times there: draw by draw where
    there are about as many values as draws, else by how often each value falls."""
    total = int(n.sum())
    if total > 8 * len(x):
        return np.concatenate([rng.multinomial(part, n / total) @ x for part in np.array_split(taken, max(1, len(taken) * len(x) // ENTRIES))])
    every = np.repeat(x, n.astype(np.int64))
    return np.array([every[rng.integers(0, total, size=int(t), dtype=np.uint32)].sum() for t in taken])


def _draw(seed: int, resamples: int):
    def run(key: tuple, frame: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        frame, shares, piece = frame.sort_values("x"), shares.sort_values("other"), int(key[1])
        sizes, at = shares["k"].to_numpy(np.float64), shares["other"].tolist().index(piece)
        x, n, name = frame["x"].to_numpy(np.float64), frame["n"].to_numpy(np.float64), int(frame["name"].iloc[0]) & (1 << 62) - 1
        sums = []
        for block, first in enumerate(range(0, resamples, BLOCK)):
            count = min(BLOCK, resamples - first)
            taken = np.random.default_rng([seed, name, block]).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=count)[:, at]
            sums.append(_sums(np.random.default_rng([seed, name, block, piece + 1]), x, n, taken))
        return pd.DataFrame({"grp": [frame["grp"].iloc[0]] * resamples, "resample": np.arange(resamples), "s": np.concatenate(sums)})

    return run


def resampled_means(rows: DataFrame, by: str, value: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """by, resample, mean: the means of `resamples` resamples of each group, each of as many values as the group has."""
    pieces, shares = _pieces(rows, by, value)
    kind = pieces.schema["grp"].dataType.simpleString()
    work = pieces.withColumn("name", F.xxhash64(F.col("grp").cast("string")))
    # a piece is few bytes and much work: partitions that aren't put together
    work = work.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "piece")
    drawn = work.groupBy("grp", "piece").cogroup(shares.groupBy("of", "at")).applyInPandas(_draw(seed, resamples), f"grp {kind}, resample long, s double")
    sizes = pieces.groupBy("grp").agg(F.sum("n").alias("total")).withColumnRenamed("grp", "g")
    sums = drawn.groupBy("grp", "resample").agg(F.sum("s").alias("s")).join(sizes, F.col("grp").eqNullSafe(F.col("g")))
    return sums.select(F.col("grp").alias(by), "resample", (F.col("s") / F.col("total")).alias("mean"))


def _interval(draws: np.ndarray, mean: float, square: float, cube: float, level: float) -> tuple[float, float]:
    """Bias-corrected, accelerated; square and cube are sums over the values' distances from their mean."""
    norm, k = NormalDist(), len(draws)
    z0 = norm.inv_cdf(min(max(float((draws < mean).sum()) / k, 0.5 / k), 1 - 0.5 / k))
    a = cube / (6 * square**1.5) if square else 0.0

    def at(q: float) -> float:
        z = z0 + norm.inv_cdf(q)
        return float(np.quantile(draws, min(1.0, max(0.0, norm.cdf(z0 + z / max(1e-12, 1 - a * z))))))

    return at((1 - level) / 2), at((1 + level) / 2)


def bootstrap_means(rows: DataFrame, by: str, value: str, resamples: int = RESAMPLES, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """by, n, mean, low, high: the interval of each group's mean. Of one value, or of
    equal ones, it is that value; a group without values has no row. What is
    brought together for a group are its resamples' means, one number each."""
    from ledgerline.plans.scratch import cut

    counts = rows.select(F.col(by).alias("grp"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)").groupBy("grp", "x").agg(F.count(F.lit(1)).alias("n"))
    means = cut(counts.groupBy("grp").agg(F.sum("n").alias("n"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most")))
    d = F.col("x") - F.col("mean")
    centred = counts.withColumnRenamed("n", "k").join(means.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g")))
    moments = centred.groupBy("grp").agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("least").alias("least"), F.max("most").alias("most"), F.sum(F.col("k") * d * d).alias("square"), F.sum(F.col("k") * d * d * d).alias("cube"))
    drawn = resampled_means(rows, by, value, resamples, seed).groupBy(F.col(by).alias("g")).agg(F.array_sort(F.collect_list("mean")).alias("draws"))
    kind = moments.schema["grp"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                low, high = (r.mean, r.mean) if r.least == r.most else _interval(np.asarray(r.draws), r.mean, r.square, r.cube, level)
                out.append((r.grp, r.n, r.least if r.least == r.most else r.mean, r.least if r.least == r.most else low, r.most if r.least == r.most else high))
            yield pd.DataFrame(out, columns=[by, "n", "mean", "low", "high"])

    both = moments.join(drawn, F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    return both.mapInPandas(run, f"`{by}` {kind}, n long, mean double, low double, high double")


def paired_report(pairs: DataFrame, metrics: list[str], arms: tuple[str, str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Per metric of pairs (columns <metric>_<arm>): n, mean_a, mean_b, mean_delta, its
    interval ci_lo, ci_hi, the test's z and p_wilcoxon, and p_holm over the metrics. Pairs with a null
    side count for neither; a metric without pairs has nulls and n = 0. A metric
    whose pairs are all equal has p 1."""
    from ledgerline.plans.scratch import cut

    each = ", ".join(f"'{m}', CAST({m}_{arms[0]} AS DOUBLE), CAST({m}_{arms[1]} AS DOUBLE)" for m in metrics)
    long = cut(pairs.select(F.expr(f"stack({len(metrics)}, {each}) as (metric, a, b)")).where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b")))
    names = pairs.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    means = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_delta"))
    spans = bootstrap_means(long, "metric", "d", resamples, seed).select("metric", F.col("low").alias("ci_lo"), F.col("high").alias("ci_hi"))
    tests = wilcoxon(long, ["metric"], "d").select("metric", "z", F.col("p").alias("p_wilcoxon"))
    told = names.join(means, "metric", "left").join(spans, "metric", "left").join(tests, "metric", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    told = cut(told.withColumn("p_wilcoxon", F.when(F.col("n") > 0, F.coalesce("p_wilcoxon", F.lit(1.0)))).withColumn("one", F.lit(1)))
    return holm(told, ["one"], "p_wilcoxon").drop("one")
