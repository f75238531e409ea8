"""How far the cosines within groups lie from those across them, without pairs.

The sum of all cosines of a group follows from the sum of its unit vectors, and
the sum of their squares from its second moments: sum (u_i . u_j)^2 is the
squared Frobenius norm of sum u u^T. Of two groups they are the products of
their sums and of their moments. One pass over the vectors, a matrix product a
batch; what is shuffled is a row per task, group and dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.vectors import dot

#: Deviations that separate a fit embedder's kinds
SIGMA = 3.0
#: numbers that a task holds at most before it hands its groups on; columns of a moment that are summed side by side
HELD, WIDE = 8_000_000, 256
#: a variance that is this share of the mean square comes of rounding
ROUNDING = 1e-14


def moments(df: DataFrame, group: str, vec: str = "embedding", unit: bool = True) -> DataFrame:
    """grp, i, j, n, zeros, own, own2, row: for each group the sum of its vectors
    (i = -1) and the rows of its second moments (i from 0), in pieces of WIDE
    columns (j). The vectors that aren't zero and those that are, their squared
    lengths and the squares of those are counted and summed beside i = -1, j = 0.
    With `unit` vectors are brought to length 1. Rows without a vector are left
    out; all others have one length."""

    def run(batches):
        held: dict = {}

        def hand_on():
            for key, (count, total, square) in held.items():
                rows = np.vstack([total[None, :], square])
                wide = range(0, rows.shape[1], WIDE)
                pieces = [(i, j, rows[i + 1, k : k + WIDE]) for i in range(-1, len(rows) - 1) for j, k in enumerate(wide)]
                i, j, row = zip(*pieces, strict=True)
                of = [pa.array([x] + [0] * (len(pieces) - 1), t) for x, t in zip([int(count[0]), int(count[1]), float(count[2]), float(count[3])], [pa.int64()] * 2 + [pa.float64()] * 2, strict=True)]
                columns = [pa.array([key] * len(pieces), kind), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *of, pa.array(row, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "i", "j", "n", "zeros", "own", "own2", "row"])
            held.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            length = np.sqrt((x * x).sum(axis=1))
            if unit:
                x = x / np.where(length == 0, 1.0, length)[:, None]
            names = batch.column(0).to_pylist()
            place = {name: k for k, name in enumerate(dict.fromkeys(names))}
            of = np.array([place[name] for name in names])
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(place) + 1))
            for name, lo, hi in zip(place, ends, ends[1:], strict=False):
                rows = order[lo:hi]
                y, some = x[rows], length[rows] > 0
                own = (y * y).sum(axis=1)
                if name not in held:
                    held[name] = [np.zeros(4), np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))]
                held[name][0] += [some.sum(), (~some).sum(), own.sum(), (own * own).sum()]
                held[name][1] += y.sum(axis=0)
                held[name][2] += y.T @ y
            if len(held) * x.shape[1] ** 2 > HELD:
                yield from hand_on()
        yield from hand_on()

    rows = df.where(F.col(vec).isNotNull()).select(F.col(group).alias("grp"), F.col(vec).cast("array<double>").alias("v"))
    kind = rows.schema["grp"].dataType.simpleString()
    parts = rows.where(F.size("v") > 0).mapInArrow(run, f"grp {kind}, i int, j int, n long, zeros long, own double, own2 double, row array<double>")
    return _summed(parts, ["grp", "i", "j"])


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    side = F.array(*[F.sum(F.get("row", F.lit(k))) for k in range(WIDE)])
    sums = [F.sum(c).alias(c) for c in ("n", "zeros", "own", "own2")]
    return parts.groupBy(*by).agg(*sums, F.filter(side, lambda x: x.isNotNull()).alias("row"))


def _spread(pairs: Column, total: Column, squares: Column, mean: str, sd: str) -> list[Column]:
    """Mean and population deviation; 0 without pairs, and where it is no more than rounding."""
    part = lambda x: F.coalesce(F.try_divide(x, F.nullif(pairs, F.lit(0))), F.lit(0.0))
    m, var = part(total), part(squares) - F.pow(part(total), F.lit(2))
    return [m.alias(mean), F.when(var <= ROUNDING * part(squares), F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0)))).alias(sd)]


def cosine_spreads(df: DataFrame, group: str, vec: str = "embedding", unit: bool = True) -> DataFrame:
    """A row a group: n, pairs, intra_mean, intra_sd of its own pairs, and
    cross_pairs, cross_mean, cross_sd of its vectors with all others.

    With `unit` these are cosines, 1.0 where either vector is zero; else inner
    products of the vectors as they are. Means and population deviations are 0
    where there is no pair. A null group is one of its own.
    """
    from ledgerline.plans.scratch import cut

    own = cut(moments(df, group, vec, unit))
    every = _summed(own, ["i", "j"]).select("i", "j", *[F.col(c).alias(f"all_{c}") for c in ("n", "zeros", "row")])
    return _by_group(own.join(every, ["i", "j"]), unit).withColumnRenamed("grp", group)


def _by_group(both: DataFrame, unit: bool) -> DataFrame:
    head = F.col("i") == -1
    at = lambda c: F.sum(F.when(head & (F.col("j") == 0), F.col(c)))
    rest = F.zip_with("all_row", "row", lambda a, b: a - b)
    of = lambda when, x: F.sum(F.when(when, x).otherwise(0.0))
    one = both.groupBy("grp").agg(
        at("n").alias("m"), at("zeros").alias("z"), at("own").alias("own"), at("own2").alias("own2"), at("all_n").alias("am"), at("all_zeros").alias("az"),
        of(head, dot(F.col("row"), F.col("row"))).alias("s"), of(~head, dot(F.col("row"), F.col("row"))).alias("q"),
        of(head, dot(F.col("row"), rest)).alias("cs"), of(~head, dot(F.col("row"), rest)).alias("cq"),
    )
    choose = lambda n: n * (n - 1) / 2
    n, others = F.col("m") + F.col("z"), F.col("am") + F.col("az") - F.col("m") - F.col("z")
    pairs, cross = choose(n), n * others
    # pairs with a zero vector count as cosine 1
    ones = choose(n) - choose(F.col("m")) if unit else F.lit(0)
    cross_ones = cross - F.col("m") * (F.col("am") - F.col("m")) if unit else F.lit(0)
    return one.select(
        "grp", n.alias("n"), pairs.cast("long").alias("pairs"), *_spread(pairs, (F.col("s") - F.col("own")) / 2 + ones, (F.col("q") - F.col("own2")) / 2 + ones, "intra_mean", "intra_sd"),
        cross.alias("cross_pairs"), *_spread(cross, F.col("cs") + cross_ones, F.col("cq") + cross_ones, "cross_mean", "cross_sd"),
    )


def kind_sigma(spreads: DataFrame, least: float = SIGMA) -> DataFrame:
    """sigma: how many pooled deviations a kind's own cosines lie from those with
    other kinds; 0 without deviation. fit: that is `least` or more."""
    pooled = F.sqrt((F.pow("intra_sd", F.lit(2)) + F.pow("cross_sd", F.lit(2))) / 2)
    sigma = F.coalesce(F.try_divide(F.abs(F.col("intra_mean") - F.col("cross_mean")), F.nullif(pooled, F.lit(0.0))), F.lit(0.0))
    return spreads.withColumn("sigma", sigma).withColumn("fit", F.col("sigma") >= least)


def duplicate_sigma(spreads: DataFrame, least: float = SIGMA) -> DataFrame:
    """sigma: how many deviations of the unrelated pairs a cluster of duplicates
    lies above them; infinite without deviation. Clusters of one are left out."""
    over = F.col("intra_mean") - F.col("cross_mean")
    sigma = F.when(F.col("cross_sd") == 0, F.lit(float("inf"))).otherwise(F.try_divide(over, F.nullif("cross_sd", F.lit(0.0))))
    return spreads.where("n >= 2").withColumn("sigma", sigma).withColumn("fit", F.col("sigma") >= least)
