"""Operators over experiment results: pairing, agreement, ranks, tests, bounds."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ship and kill thresholds
SHIP_GAIN, SHIP_HARM, SHIP_COST, KILL_GAIN, KILL_HARM, ALPHA = 0.15, 0.05, 1.5, -0.05, -0.10, 0.05


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def pair_arms(results: DataFrame, task: str, arm: str, arms: tuple[str, str], metrics: list[str]) -> DataFrame:
    """Tasks that both arms have, one row each; columns <metric>_<arm>. Of
    repeated rows the greatest value stays."""
    wide = results.groupBy(task).pivot(arm, list(arms)).agg(*[F.max(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        wide = wide.select(task, *[F.col(a).alias(f"{a}_{metrics[0]}") for a in arms])
    return wide.select(task, *[F.col(f"{a}_{m}").alias(f"{m}_{a}") for m in metrics for a in arms]).dropna()


def valid_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups with exactly two rows, of both arms, all valid."""
    ok = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.countDistinct("arm").alias("__arms"), F.bool_and("valid").alias("__ok"))
    return rows.join(ok.where("__n = 2 and __arms = 2 and __ok").select(*keys), keys, "left_semi")


def summarize(pairs: DataFrame, metrics: list[str], arms: tuple[str, str]) -> DataFrame:
    """Per metric: pairs, means of both arms and the mean difference."""
    each = ", ".join(f"'{m}', CAST({m}_{arms[0]} AS DOUBLE), CAST({m}_{arms[1]} AS DOUBLE)" for m in metrics)
    long = pairs.select(F.expr(f"stack({len(metrics)}, {each}) as (metric, a, b)"))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("mean_delta"))


def verdict(drop: Column, p_holm: Column, resolved: Column, latency: Column) -> Column:
    """ship where regressions fell by enough, and significantly, tasks were not
    resolved more rarely and latency held; else kill where either got much worse;
    else inconclusive. drop: vanilla less treatment; resolved: treatment less
    vanilla; latency: their ratio. Nulls and NaN prove nothing."""
    sure = F.coalesce((p_holm < ALPHA) & ~F.isnan(p_holm), F.lit(False))
    ship = (drop >= SHIP_GAIN) & sure & (resolved >= -SHIP_HARM) & (latency <= SHIP_COST)
    return F.when(ship, "ship").when((drop < KILL_GAIN) | (resolved < KILL_HARM), "kill").otherwise("inconclusive")


def confusion(rows: DataFrame, category: str | None = None) -> DataFrame:
    """truth, guess (booleans) -> counts, precision, recall, false-positive rate
    and F1 (0 on an empty denominator), overall (category null) and per category in one pass."""
    t, g = F.col("truth"), F.col("guess")
    counts = [count_where(t & g).alias("tp"), count_where(~t & g).alias("fp"), count_where(t & ~g).alias("fn"), count_where(~t & ~g).alias("tn")]
    got = rows.rollup(category).agg(*counts) if category else rows.agg(*counts)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0))), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return got.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "fpr": share(fp, fp + tn), "f1": share(2 * tp, 2 * tp + fp + fn)
    })


def kappa(a: Column, b: Column, chance_cap: float = 1.0) -> Column:
    """Cohen's kappa of two 0/1 columns, as an aggregate; 1 or 0 where chance reaches the cap."""
    x, y = F.avg(a.cast("double")), F.avg(b.cast("double"))
    same = F.avg((a == b).cast("double"))
    chance = x * y + (1 - x) * (1 - y)
    return F.when(chance >= chance_cap, F.when(same >= 1.0, F.lit(1.0)).otherwise(0.0)).otherwise(F.try_divide(same - chance, 1 - chance))


def pairwise_kappa(votes: DataFrame, judges: list[str]) -> DataFrame:
    """Kappa of each two judges over the rows that all have judged."""
    full = votes.dropna(subset=judges)
    pairs = [(a, b) for i, a in enumerate(judges) for b in judges[i + 1 :]]
    one = full.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), kappa(F.col(a), F.col(b)).alias("kappa")) for a, b in pairs]).alias("k"))
    return one.select(F.inline("k"))


def majority(labels: Column) -> Column:
    """The label that at least two of the non-null votes share; of several, the one seen first; else null."""
    seen = F.filter(labels, lambda x: x.isNotNull())
    n = lambda x: F.size(F.filter(seen, lambda y: y == x))
    scored = F.transform(F.array_distinct(seen), lambda x, i: F.struct((-n(x)).alias("n"), i.alias("i"), x.alias("label")))
    best = F.array_min(scored)
    return F.when(best["n"] <= -2, best["label"])


def cumulative(rows: DataFrame, by: list[str], value: str, *aggs: Column, pieces: int = 100) -> DataFrame:
    """by, value, n, the given aggregates, below: of each distinct value in its
    group how many rows have it and how many a smaller one.

    Rows are counted per distinct value first; running sums are taken within
    pieces of the values' range and over the pieces, so that no task sorts a
    whole group. Null values are left out; NaN is the greatest.
    """
    return _running(rows, by, value, *aggs, pieces=pieces).drop("__total")


def _running(rows: DataFrame, by: list[str], value: str, *aggs: Column, pieces: int = 100) -> DataFrame:
    """As cumulative, and __total, the rows of each group. The counts are written: three steps read them."""
    from ledgerline.plans.scratch import written

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *aggs)
    counts = written(counts)
    cuts = counts.agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)])).first()[0] or []  # `pieces` numbers at most
    piece = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    placed = counts.withColumn("__piece", piece)
    inside = F.sum("n").over(W.partitionBy(*by, "__piece").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    sums = placed.groupBy(*by, "__piece").agg(F.sum("n").alias("__n"))  # `pieces` rows a group
    before = F.sum("__n").over(W.partitionBy(*by or [F.lit(1)]).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*by, "__piece", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(*by or [F.lit(1)])).alias("__total"))
    same = F.col("p.__piece") == F.col("o.__piece")
    for c in by:
        same = same & F.col(f"p.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
    joined = placed.withColumn("__inside", F.coalesce(inside, F.lit(0))).alias("p").join(offsets.alias("o"), same)
    return joined.select("p.*", (F.col("__before") + F.col("__inside")).alias("below"), "__total").drop("__piece", "__inside")


def _alike(left: str, right: str, by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return same


def exact_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by, n (of the values that aren't null), and the wanted quantiles, linear
    between neighbours, as columns; a group without values has no row. From
    running counts of distinct values, so that no task holds a group."""
    both = _running(rows, by, value)
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value).cast("double")))
    place = lambda q: (F.col("__total") - 1) * F.lit(q)
    ends = [c for name, q in wanted.items() for c in (at(F.floor(place(q))).alias(f"__lo_{name}"), at(F.ceil(place(q))).alias(f"__hi_{name}"))]
    found = both.groupBy(*by).agg(F.max("__total").alias("__total"), *ends).where("__total is not null")
    value_of = lambda name, q: F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (place(q) - F.floor(place(q)))
    return found.select(*by, F.col("__total").alias("n"), *[value_of(name, q).alias(name) for name, q in wanted.items()])


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """ROC-AUC from rank sums over the distinct scores; ties count half. NaN if a class is empty."""
    seen = cumulative(rows, [], score, count_where(F.col(positive)).alias("p"))
    # rank sum of the positives, with ties averaged, less its least value
    ranks, p, n = F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2.0)), F.sum("p"), F.sum("n")
    return seen.agg(F.coalesce(F.try_divide(ranks - p * (p + 1) / 2.0, F.nullif(p * (n - p), F.lit(0))), F.lit(float("nan"))).alias("auc"))


def _with_size(seen: DataFrame, by: str) -> DataFrame:
    sizes = seen.groupBy(by).agg(F.sum("n").alias("__n")).withColumnRenamed(by, "__by")
    return seen.join(sizes, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def arm_summary(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """n, sum, upper median sorted[n // 2] and the ceil(.9 n)-th value of each arm; null values are left out."""
    seen = _with_size(cumulative(rows, [arm], value), arm)
    at = lambda k: F.max(F.when((F.col("below") < k) & (k <= F.col("below") + F.col("n")), F.col(value)))
    return seen.groupBy(arm).agg(
        F.sum("n").alias("n"),
        F.sum(F.col(value) * F.col("n")).alias("total"),
        at(F.floor(F.col("__n") / 2) + 1).alias("upper_median"),
        at(F.greatest(F.lit(1), F.ceil(F.col("__n") * 0.9))).alias("p90"),
    )


#: Floors of two raters' agreement, on what they say and on how much
JACCARD_FLOOR, PEARSON_FLOOR = 0.6, 0.7


def rater_agreement(rows: DataFrame, jaccard: str, count_a: str, count_b: str) -> DataFrame:
    """One row: n documents, their mean, upper median, least and greatest
    Jaccard (0 without any), Pearson of how much the raters say (null below two
    documents or where one says the same everywhere), and whether both floors are met."""
    from ledgerline.plans.scratch import cut

    kept = cut(rows.where(F.col(jaccard).isNotNull()).select(F.lit(0).alias("one"), F.col(jaccard).alias("j"), F.col(count_a).cast("double").alias("a"), F.col(count_b).cast("double").alias("b")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    varies = (F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))
    one = kept.agg(F.count(F.lit(1)).alias("n"), zero(F.avg("j")).alias("mean_jaccard"), zero(F.min("j")).alias("least"), zero(F.max("j")).alias("most"), F.when(varies, F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))).alias("pearson"))
    middle = arm_summary(kept, "one", "j").select(F.col("upper_median").alias("median_jaccard"))
    both = one.join(middle, how="left").withColumn("median_jaccard", zero(F.col("median_jaccard")))  # a row each
    alike, counted = F.col("mean_jaccard") >= JACCARD_FLOOR, F.coalesce(F.col("pearson") >= PEARSON_FLOOR, F.lit(False))
    return both.withColumns({"jaccard_pass": alike, "pearson_pass": counted, "overall_pass": alike & counted})


def exclusive_quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles at places p (n + 1), interpolated; groups of 4 rows at least, null values left out."""
    seen = _with_size(cumulative(rows.select(by, F.col(value).cast("double").alias("__v")), [by], "__v"), by)

    def at(p: float) -> Column:
        place = p * (F.col("__n") + 1)
        low = F.least(F.greatest(F.floor(place), F.lit(1)), F.col("__n") - 1)
        holds = lambda k: (F.col("below") < k) & (k <= F.col("below") + F.col("n"))
        share = F.when(holds(low), 1 - (place - low)).otherwise(0.0) + F.when(holds(low + 1), place - low).otherwise(0.0)
        return F.sum(F.col("__v") * share)

    return seen.where("__n >= 4").groupBy(by).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each row with its rank in its group, ties averaged, and how many share it; rows with a null value are left out."""
    seen = cumulative(rows, by, value).select(*[F.col(c).alias(f"__{c}") for c in [*by, value]], F.col("n").alias("peers"), (F.col("below") + (F.col("n") + 1) / 2.0).alias("rank"))
    same = F.col(value) == F.col(f"__{value}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(seen, same).drop(*[f"__{c}" for c in [*by, value]])


def wilcoxon(rows: DataFrame, by: list[str], delta: str) -> DataFrame:
    """Signed-rank test, normal approximation with tie and continuity correction:
    n, w (the smaller rank sum), z, p. Zero differences are left out."""
    kept = rows.where(F.col(delta) != 0).withColumn("__a", F.abs(delta))
    seen = cumulative(kept, by, "__a", count_where(F.col(delta) > 0).alias("__up"))
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    plus, minus = F.sum(rank * F.col("__up")), F.sum(rank * (F.col("n") - F.col("__up")))
    ties = F.sum(F.col("n") * (F.col("n") * F.col("n") - 1))  # t^3 - t for each t that tie
    agg = seen.groupBy(*by).agg(F.sum("n").alias("n"), F.least(plus, minus).alias("w"), ties.alias("__t"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("__t") / 48
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(F.col("w") - n * (n + 1) / 4) - 0.5), F.nullif(F.sqrt(var), F.lit(0.0)))
    out = agg.withColumn("z", z).drop("__t")

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(x / math.sqrt(2)) if x == x else 1.0)

    return out.withColumn("p", two_sided("z"))


def holm(rows: DataFrame, by: list[str], p: str) -> DataFrame:
    """Step-down adjusted p; null and NaN are skipped and stay null."""
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    w = W.partitionBy(*by, ok).orderBy(p)
    m = F.count(F.lit(1)).over(W.partitionBy(*by, ok))
    raw = (m - F.row_number().over(w) + 1) * F.col(p)
    stepped = rows.withColumn("__raw", raw)
    running = F.max("__raw").over(w.rowsBetween(W.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.when(ok, F.least(F.lit(1.0), running))).drop("__raw")


def _half_tail(k: int, n: int) -> float:
    """P(X <= k) of n fair coins: exact sums up to 1,000 of them, else the last term and the falling ones below it."""
    if k >= n:
        return 1.0
    if n <= 1000:
        return sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    if 2 * k > n:
        return 1 - _half_tail(n - k - 1, n)
    term = total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    while k and term > total * 1e-17:
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return total


def sign_test_p(wins: int, losses: int, alternative: str = "greater") -> float:
    """Binomial tail at one half: of as many wins or more, as few or fewer, or
    twice the smaller of the two. 1 if there is neither a win nor a loss."""
    n = wins + losses
    if alternative == "greater":
        return _half_tail(losses, n)
    if alternative == "less":
        return _half_tail(wins, n)
    if alternative == "two-sided":
        return min(1.0, 2 * _half_tail(min(wins, losses), n))
    raise ValueError(alternative)


def sign_test(rows: DataFrame, by: list[str], delta: str, alternative: str = "greater") -> DataFrame:
    """wins, losses and the test's p; ties and nulls count as neither. One sum a group is taken in Python."""
    exact = F.udf(lambda w, l: sign_test_p(w, l, alternative), "double")
    counts = rows.groupBy(*by).agg(count_where(F.col(delta) > 0).alias("wins"), count_where(F.col(delta) < 0).alias("losses"))
    return counts.withColumn("p", exact("wins", "losses"))


def _binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k): the term at the edge and those that fall away from it, on the lighter side."""
    if k >= n:
        return 1.0
    if p <= 0 or p >= 1:
        return 1.0 if p <= 0 else 0.0
    at = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    below = k <= n * p
    i = k if below else k + 1
    term = total = at(i)
    while term > total * 1e-18 and 0 <= i <= n:
        term *= i / (n - i + 1) * (1 - p) / p if below else (n - i) / (i + 1) * p / (1 - p)
        total += term
        i += -1 if below else 1
    return total if below else 1 - total


def exact_bounds(k: int, n: int, alpha: float) -> tuple[float, float]:
    """One-sided Clopper-Pearson bounds at level alpha each, by bisection."""

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k <= 0 else solve(lambda p: 1 - _binomial_cdf(k - 1, n, p) < alpha)
    high = 1.0 if k >= n else solve(lambda p: _binomial_cdf(k, n, p) > alpha)
    return low, high


def rate_bounds(rows: DataFrame, strata: str, event: str, alpha: float = 0.025) -> DataFrame:
    """Events and rows with exact bounds of the rate, per stratum and overall (null) in one pass."""
    counts = rows.rollup(strata).agg(count_where(F.col(event)).alias("k"), F.count(F.lit(1)).alias("n"))
    bounds = F.udf(lambda k, n: exact_bounds(k, n, alpha) if n else (None, None), "low double, high double")
    return counts.withColumn("b", bounds("k", "n")).select(strata, "k", "n", "b.low", "b.high")


def rate_ratio(k1: int, n1: int, k0: int, n0: int, alpha: float) -> dict[str, float]:
    """Ratio of two rates and its bounds from exact bounds at half the level each."""
    low1, high1 = exact_bounds(k1, n1, alpha / 2)
    low0, high0 = exact_bounds(k0, n0, alpha / 2)
    ratio = (k1 / n1) / (k0 / n0) if n1 and n0 and k0 else math.inf
    return {"ratio": ratio, "low": low1 / high0 if high0 else math.inf, "high": high1 / low0 if low0 else math.inf}


def difference_bound(k1: int, n1: int, k0: int, n0: int, alpha: float) -> float:
    """Lower bound of a difference of rates; each side's share of the error is alpha / 4."""
    return exact_bounds(k1, n1, alpha / 4)[0] - exact_bounds(k0, n0, alpha / 4)[1]


def bca(values: list[float], resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected accelerated bootstrap interval of the mean."""
    n = len(values)
    if n < 2 or min(values) == max(values):
        return (math.nan, math.nan) if not n else (values[0], values[0]) if n == 1 or min(values) == max(values) else (math.nan, math.nan)
    rng, norm = random.Random(seed), NormalDist()
    mean = math.fsum(values) / n
    draws = sorted(math.fsum(rng.choices(values, k=n)) / n for _ in range(resamples))
    below = sum(d < mean for d in draws)
    z0 = norm.inv_cdf(min(max(below / resamples, 0.5 / resamples), 1 - 0.5 / resamples))
    jack = [(mean * n - v) / (n - 1) for v in values]
    centre = math.fsum(jack) / n
    cube, square = math.fsum((centre - j) ** 3 for j in jack), math.fsum((centre - j) ** 2 for j in jack)
    a = cube / (6 * square**1.5) if square else 0.0

    def at(q: float) -> float:
        z = z0 + norm.inv_cdf(q)
        place = norm.cdf(z0 + z / (1 - a * z)) * (resamples - 1)
        i = min(int(place), resamples - 2)
        return draws[i] + (draws[i + 1] - draws[i]) * (place - i)

    return at((1 - level) / 2), at((1 + level) / 2)


def kappa_interval(pairs: list[tuple[int, int]], resamples: int = 1_000, seed: int = 7) -> tuple[float, float]:
    """Percentile bootstrap of kappa; resamples without two classes are dropped."""
    rng, draws, n = random.Random(seed), [], len(pairs)
    for _ in range(resamples if n else 0):
        got = [pairs[rng.randrange(n)] for _ in range(n)]
        a, b = sum(x for x, _ in got) / n, sum(y for _, y in got) / n
        chance = a * b + (1 - a) * (1 - b)
        if chance < 1:
            draws.append((sum(x == y for x, y in got) / n - chance) / (1 - chance))
    draws.sort()
    return (draws[int(0.025 * (len(draws) - 1))], draws[int(0.975 * (len(draws) - 1))]) if draws else (math.nan, math.nan)


def minimal_effect(n: Column, sd: Column, alpha: float = 0.05, power: float = 0.8, inflation: float = 1.0) -> Column:
    """Smallest detectable mean difference of n pairs (inflation 3 / pi ... for rank tests)."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return z * sd * math.sqrt(inflation) / F.sqrt(n)


def design_effect(size: Column, icc: Column) -> Column:
    return 1 + (size - 1) * icc


def intra_class(rows: DataFrame, keys: list[str], task: str, judge: str, value: str) -> DataFrame:
    """Between and within variance of task means per key, and their share: judges' means make a cell."""
    cells = rows.groupBy(*keys, task, judge).agg(F.avg(value).alias("__c"))
    tasks = cells.groupBy(*keys, task).agg(F.avg("__c").alias("__m"), F.when(F.count("__c") > 1, F.var_samp("__c")).alias("__v"))
    both = tasks.groupBy(*keys).agg(F.when(F.count("__m") > 1, F.var_samp("__m")).alias("between"), F.avg("__v").alias("within"))
    return both.withColumn("icc", F.try_divide(F.col("between"), F.col("between") + F.col("within")))


def median_of_ratios(rows: DataFrame, probe: str, top: str, bottom: str) -> DataFrame:
    """Median per probe of both columns, their ratio, then the median ratio. Probes without a value in either count, but have no ratio."""
    from ledgerline.plans.scratch import cut

    probes = rows.select(probe).distinct()
    side = lambda c, name: exact_quantiles(rows.select(probe, c), [probe], c, {name: 0.5}).drop("n")
    a, b = side(top, "__a"), side(bottom, "__b")
    each = probes.alias("p").join(a.alias("a"), _alike("p", "a", [probe]), "left").join(b.alias("b"), _alike("p", "b", [probe]), "left")
    each = cut(each.select(F.try_divide("__a", F.nullif("__b", F.lit(0.0))).alias("ratio")))
    n = each.agg(F.count(F.lit(1)).alias("n_probes"))
    return n.join(exact_quantiles(each, [], "ratio", {"middle": 0.5}).select(F.col("middle").alias("ratio")), how="left")  # a row each


def corpus_check(rows: DataFrame, key: str, stratum: str, behaviour: str, least: int, overall: int, size: int | None = None) -> DataFrame:
    """Rows, distinct ids and distinct behaviours per stratum and overall (null),
    and whether they suffice: no id twice, enough behaviours, and, if given, as many
    rows in each stratum."""
    told = rows.withColumn("__b", F.lower(F.regexp_replace(behaviour, r"[^A-Za-z0-9]+", " ")))
    got = told.rollup(stratum).agg(F.countDistinct("__b").alias("n_behaviours"), F.countDistinct(key).alias("n_ids"), F.count(F.lit(1)).alias("n"), F.grouping(stratum).alias("__all"))
    ok = (F.col("n_ids") == F.col("n")) & (F.col("n_behaviours") >= F.when(F.col("__all") == 1, overall).otherwise(least))
    if size is not None:
        ok = ok & ((F.col("__all") == 1) | (F.col("n") == size))
    return got.withColumn("ok", ok).drop("__all")
