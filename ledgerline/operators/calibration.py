"""Anomaly calibration of risk vectors: shrunk covariance, thresholds per kind."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.scratch import cut

#: Rows that a fit takes, weight of the global threshold, resamples and seed of its interval, share of false alarms
LEAST_ROWS, GLOBAL_WEIGHT, RESAMPLES, SEED, FPR = 50, 5, 1_000, 11, 0.02

MODEL = "kind string, n long, mean array<double>, inverse array<array<double>>, threshold double, low double, high double"


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf: the sample covariance drawn to a multiple of the identity.
    The variance of its entries needs only sum |x|^4, no outer product a row."""
    n = len(x)
    c = x - x.mean(axis=0)
    return _shrink(n, c.T @ c / n, ((c**2).sum(axis=1) ** 2).sum())


def _shrink(n: int, s: np.ndarray, fourth: float) -> np.ndarray:
    """From the number of rows, their covariance and their sum |x|^4 about the mean."""
    d = len(s)
    mu = np.trace(s) / d
    spread = ((s - mu * np.eye(d)) ** 2).sum()
    noise = fourth / n**2 - (s**2).sum() / n
    share = 0.0 if spread <= 0 else min(1.0, max(0.0, noise / spread))
    return (1 - share) * s + share * mu * np.eye(d)


def inverse(cov: np.ndarray) -> np.ndarray:
    """Symmetric; zeros where there is none."""
    try:
        got = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        return np.zeros_like(cov)
    return (got + got.T) / 2 if np.isfinite(got).all() else np.zeros_like(cov)


def distances(x: np.ndarray, mean: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances; infinite where the inverse is all zero."""
    if not inv.any():
        return np.full(len(x), np.inf)
    c = x - mean
    return np.einsum("ij,jk,ik->i", c, inv, c)


def quantile(d, q: float) -> float:
    """Linear between neighbours; infinite where the greater of them is."""
    d = np.sort(np.asarray(d, dtype=np.float64))
    at = (len(d) - 1) * q
    lo, hi = d[int(at)], d[min(int(at) + 1, len(d) - 1)]
    return float(lo if at == int(at) else hi if np.isinf(hi) else lo + (hi - lo) * (at - int(at)))


def fit(x: np.ndarray, fpr: float = FPR, resamples: int = RESAMPLES, seed: int = SEED) -> dict:
    """Mean, inverse, the (1 - fpr) quantile of the distances and its bootstrap interval."""
    mean, inv = x.mean(axis=0), inverse(shrunk_covariance(x))
    d = distances(x, mean, inv)
    rng = np.random.default_rng(seed)
    draws = [np.quantile(d[rng.integers(0, len(d), len(d))], 1 - fpr) for _ in range(resamples)] if np.isfinite(d).all() else [math.inf]
    return {"n": len(x), "mean": mean, "inverse": inv, "threshold": quantile(d, 1 - fpr), "low": float(np.quantile(draws, 0.025)), "high": float(np.quantile(draws, 0.975))}


def leave_one_out(x: np.ndarray, fpr: float = 0.05) -> float:
    """The quantile of each row's distance under the fit of the others; two rows
    at least. The others' moments are all rows' less the row's own, about a mean
    that moved by e = -c / (n - 1), so a row costs no pass over the others."""
    n = len(x)
    c = x - x.mean(axis=0)
    square, scatter = (c**2).sum(axis=1), c.T @ c
    cubic, fourth = square @ c, (square**2).sum()
    d = []
    for own, sq in zip(c, square, strict=True):
        e = -own / (n - 1)
        ee = e @ e
        # sum over all rows of |c - e|^4, less the row's own
        quartic = fourth - 4 * e @ cubic + 4 * e @ scatter @ e + 2 * ee * square.sum() + n * ee**2 - ((own - e) @ (own - e)) ** 2
        cov = (scatter - np.outer(own, own) * n / (n - 1)) / (n - 1)
        if np.trace(cov) <= 1e-12 * square.sum():  # nothing but rounding is left
            cov, quartic = np.zeros_like(cov), 0.0
        d.append(distances((own - e)[None], np.zeros_like(own), inverse(_shrink(n - 1, cov, quartic)))[0])
    return quantile(d, 1 - fpr)


#: accuracy of the sketch that bounds what is looked at for exact quantiles; steps around the quantile that are asked of it
ACCURACY = 100_000
STEPS = [4 / ACCURACY * 2**i for i in range(15)]


def _ranks(n: int, fpr: float, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ranks (from 1) of the two values that the (1 - fpr) quantile of n values lies between, first their own and
    then of resamples of n, and the place between. A resample's order statistics are drawn as such: ranks
    n U of order statistics U of n uniform numbers, so no resample is made."""
    at = (n - 1) * (1 - fpr)
    k = int(at)
    rng = np.random.default_rng(seed)
    u = rng.beta(k + 1, n - k, resamples)
    w = u + (1 - u) * rng.beta(1, n - k - 1, resamples) if k + 2 <= n else u
    rank = lambda x: np.clip(np.ceil(n * x), 1, n).astype(np.int64)
    return np.append(k + 1, rank(u)), np.append(min(k + 2, n), rank(w)), at - k


def _with_distance(joined: DataFrame, vec: str, name: str) -> DataFrame:
    """Squared Mahalanobis distance of rows that have a model's mean and inverse."""
    with_delta = joined.withColumn("__d", F.zip_with(F.col(vec).cast("array<double>"), "mean", lambda a, b: a - b))
    sum_ = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    rows_ = F.transform("inverse", lambda r: sum_(F.zip_with(r, "__d", lambda a, b: a * b)))
    empty = ~F.exists("inverse", lambda r: F.exists(r, lambda x: x != 0))
    d2 = F.when(empty, F.lit(float("inf"))).otherwise(sum_(F.zip_with(rows_, "__d", lambda a, b: a * b)))
    return with_delta.withColumn(name, d2).drop("__d")


def _fit_all(rows: DataFrame, fpr: float, least: int) -> DataFrame:
    """fit() for each kind of `least` rows or more, over all of its rows (kind, v): moments and quantiles are aggregates."""
    dim = rows.select(F.size("v").alias("d")).first()
    if dim is None:
        return rows.sparkSession.createDataFrame([], MODEL)
    d, v = dim.d, F.col("v")
    on = lambda df: df.withColumnRenamed("kind", "__kind")
    same = F.col("kind").eqNullSafe(F.col("__kind"))
    means = cut(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(v[i]) for i in range(d))).alias("mean")).where(F.col("n") >= least))
    c = F.col("c")
    centred = rows.join(on(means), same).withColumn("c", F.zip_with("v", "mean", lambda a, b: a - b))
    square = F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)
    products = F.array(*(F.sum(c[i] * c[j]) for i in range(d) for j in range(i, d)))
    moments = centred.groupBy("kind").agg(F.max("n").alias("n"), F.any_value("mean").alias("mean"), products.alias("products"), F.sum(square * square).alias("fourth"))

    def invert(frames):
        for frame in frames:
            got = []
            for n, products, fourth in zip(frame["n"], frame["products"], frame["fourth"], strict=True):
                s = np.zeros((d, d))
                s[np.triu_indices(d)] = np.asarray(products, float) / n
                got.append(inverse(_shrink(n, s + np.triu(s, 1).T, fourth)).tolist())
            yield frame[["kind", "n", "mean"]].assign(inverse=pd.Series(got, index=frame.index, dtype=object))

    models = cut(moments.mapInPandas(invert, "kind string, n long, mean array<double>, inverse array<array<double>>"))
    far = cut(_with_distance(rows.join(on(models), same), "v", "d").select("kind", "n", "d"))
    grid = sorted({min(1.0, max(0.0, 1 - fpr + side * step)) for side in (-1, 1) for step in STEPS})

    def bound(frames):
        """Values that the ranks looked for are certainly within."""
        for frame in frames:
            out = []
            for n, values in zip(frame["n"], frame["values"], strict=True):
                low, high, _ = _ranks(n, fpr, RESAMPLES, SEED)
                under = [x for p, x in zip(grid, values, strict=True) if p <= low.min() / n - 2 / ACCURACY]
                over = [x for p, x in zip(grid, values, strict=True) if p >= high.max() / n + 2 / ACCURACY]
                out.append((under[-1] if under else -math.inf, over[0] if over else math.inf))
            yield frame[["kind"]].assign(least=[x for x, _ in out], most=[x for _, x in out])

    sketch = far.groupBy("kind").agg(F.max("n").alias("n"), F.percentile_approx("d", grid, ACCURACY).alias("values"))
    bounds = cut(sketch.mapInPandas(bound, "kind string, least double, most double"))
    within = far.join(on(bounds), same).where(F.col("d") <= F.col("most")).groupBy("kind", F.when(F.col("d") >= F.col("least"), F.col("d")).alias("d"))
    counts = within.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))

    def select(frame: pd.DataFrame) -> pd.DataFrame:
        n, frame = int(frame["n"].iloc[0]), frame.sort_values("d", na_position="first")
        upto, values = frame["times"].cumsum().to_numpy(), frame["d"].to_numpy()
        low, high, part = _ranks(n, fpr, RESAMPLES, SEED)
        if high.max() > upto[-1] or np.isnan(values[np.searchsorted(upto, low.min())]):
            raise RuntimeError("a quantile lies outside of its bounds")
        a, b = values[np.searchsorted(upto, low)], values[np.searchsorted(upto, high)]
        q = np.where(a == b, a, a + part * np.where(np.isinf(b), 0, b - a))
        return pd.DataFrame({"kind": [frame["kind"].iloc[0]], "threshold": q[:1], "low": [np.quantile(q[1:], 0.025) if np.isfinite(q).all() else math.inf], "high": [np.quantile(q[1:], 0.975) if np.isfinite(q).all() else math.inf]})

    found = counts.groupBy("kind").applyInPandas(select, "kind string, threshold double, low double, high double")
    return cut(models.join(on(found), same).select("kind", "n", "mean", "inverse", "threshold", "low", "high"))


def fit_kinds(rows: DataFrame, kind: str, vec: str, fpr: float = FPR) -> DataFrame:
    """A model per kind, of all of its rows; n counts them. Kinds below LEAST_ROWS have the
    global model; the others' thresholds are drawn to the global one. Fewer than
    LEAST_ROWS rows in all give no models."""
    every = rows.select(F.col(kind).cast("string").alias("kind"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    whole = _fit_all(every.withColumn("kind", F.lit("")), fpr, LEAST_ROWS).first()
    if whole is None:
        return rows.sparkSession.createDataFrame([], MODEL)
    own = _fit_all(every, fpr, LEAST_ROWS)
    drawn = (F.col("n") * F.col("threshold") + F.lit(GLOBAL_WEIGHT * whole.threshold)) / (F.col("n") + GLOBAL_WEIGHT)
    few = every.groupBy("kind").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < LEAST_ROWS).select("kind", F.col("__n").alias("n"))
    one = rows.sparkSession.createDataFrame([(whole.mean, whole.inverse, whole.threshold, whole.low, whole.high)], MODEL.partition("n long, ")[2])
    return own.withColumn("threshold", drawn).unionByName(few.crossJoin(one))  # a row


def score(rows: DataFrame, models: DataFrame, kind: str, vec: str) -> DataFrame:
    """distance and fired (above the kind's threshold); built-in functions only, models joined by kind."""
    m = models.select(F.col("kind").alias("__kind"), "mean", "inverse", "threshold")
    joined = rows.join(m, F.col(kind).cast("string") == F.col("__kind"), "left")
    return _with_distance(joined, vec, "distance").withColumn("fired", F.col("distance") > F.col("threshold")).drop("__kind", "mean", "inverse")


def drift_levels(spark, days: int, rate: float, level: float, runs: int, seed: int = 5) -> DataFrame:
    """Simulated Type-I error and power of the cumulative-sum alarm: share of runs
    with an alarm at the target rate and at `level`."""

    def run(frames):
        for frame in frames:
            out = []
            for i in frame["id"]:
                rng = np.random.default_rng([seed, int(i)])
                alarm = {}
                for name, p in (("null", rate), ("drift", level)):
                    cum = np.cumsum(rng.binomial(50, p, days) / 50 - rate - 0.02)
                    alarm[name] = bool((cum - np.minimum(0, np.minimum.accumulate(cum)) > 0.06).any())
                out.append(alarm)
            yield pd.DataFrame(out)

    sims = spark.range(runs).mapInPandas(run, "null boolean, drift boolean")
    return sims.agg(F.avg(F.col("null").cast("double")).alias("type_i"), F.avg(F.col("drift").cast("double")).alias("power"))
