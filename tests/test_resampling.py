"""Bootstrap intervals against plain resampling."""

import math
import random

import numpy as np
import pytest

from ledgerline.operators import experiments as E
from ledgerline.operators import resampling as R

ROWS = "g string, x double"


def test_resamples_are_drawn_from_all_values(spark, monkeypatch):
    """Means of resamples have the values' mean and its standard error, whole or in pieces, and are the same every time."""
    rng = random.Random(1)
    values = [rng.expovariate(1) for _ in range(400)] + [9.0] * 100
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0), ("b", 4.0), (None, 1.0), (None, 5.0), ("b", None), ("b", math.nan)], ROWS).repartition(3)
    for piece in (10_000, 60):
        monkeypatch.setattr(R, "PIECE", piece)
        got = R.resampled_means(df, "g", "x", 1200).collect()
        by = {}
        for r in got:
            by.setdefault(r.g, {})[r.resample] = r.mean
        assert set(by) == {"a", "b", None} and all(sorted(v) == list(range(1200)) for v in by.values())
        means = np.array(list(by["a"].values()))
        se = np.std(values) / math.sqrt(len(values))
        assert abs(means.mean() - np.mean(values)) < 5 * se / math.sqrt(1200) and 0.9 < means.std() / se < 1.1
        shares = np.unique(np.round(list(by["b"].values()), 9), return_counts=True)
        assert shares[0].tolist() == [2.0, 3.0, 4.0] and 0.4 < shares[1][1] / 1200 < 0.6
        again = {(r.g, r.resample): r.mean for r in R.resampled_means(df.repartition(7), "g", "x", 1200).collect()}
        assert again == pytest.approx({(r.g, r.resample): r.mean for r in got})


def test_intervals_are_those_of_plain_resampling(spark):
    rng = random.Random(2)
    groups = {"skewed": [rng.expovariate(1) ** 2 for _ in range(60)], "even": [rng.gauss(0, 1) for _ in range(80)], "one": [3.5], "same": [2.0, 2.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], ROWS)
    got = {r.g: r for r in R.bootstrap_means(df, "g", "x", 4000).collect()}
    assert set(got) == set(groups)
    for g in ("skewed", "even"):
        low, high = E.bca(groups[g], 4000)
        assert got[g].n == len(groups[g]) and got[g].mean == pytest.approx(np.mean(groups[g]))
        assert (got[g].low, got[g].high) == pytest.approx((low, high), abs=0.08 * (high - low))
    assert (got["one"].low, got["one"].high) == (3.5, 3.5) and (got["same"].low, got["same"].high) == (2.0, 2.0)
    assert R.bootstrap_means(df.limit(0), "g", "x", 100).count() == 0


def test_paired_report(spark):
    rng = random.Random(3)
    rows = [(float(k), k + rng.gauss(0.4, 1), 1.0, 1.0, None, 2.0) for k in range(40)]
    pairs = spark.createDataFrame(rows, "cost_t double, cost_v double, done_t double, done_v double, gone_t double, gone_v double")
    got = {r.metric: r for r in R.paired_report(pairs, ["cost", "done", "gone"], ("t", "v"), 2000).collect()}
    deltas = [r[0] - r[1] for r in rows]
    cost = got["cost"]
    assert cost.n == 40 and cost.mean_delta == pytest.approx(np.mean(deltas)) and (cost.ci_lo, cost.ci_hi) == pytest.approx(E.bca(deltas, 2000), abs=0.05)
    assert 0 < cost.p_wilcoxon < 0.2 and cost.p_holm == pytest.approx(min(1.0, 2 * cost.p_wilcoxon))  # two metrics are tested
    assert (got["done"].n, got["done"].ci_lo, got["done"].ci_hi, got["done"].p_wilcoxon, got["done"].p_holm) == (40, 0.0, 0.0, 1.0, 1.0)
    assert (got["gone"].n, got["gone"].mean_delta, got["gone"].ci_lo, got["gone"].p_wilcoxon, got["gone"].p_holm) == (0, None, None, None, None)


def test_rater_agreement(spark):
    rows = spark.createDataFrame([(0.2, 1, 2), (0.9, 4, 5), (0.7, 2, 4), (0.8, 3, 3), (None, 9, 0)], "j double, a long, b long")
    got = E.rater_agreement(rows, "j", "a", "b").first()
    assert (got.n, got.median_jaccard, got.least, got.most) == (4, 0.8, 0.2, 0.9) and got.mean_jaccard == pytest.approx(0.65) and got.pearson == pytest.approx(np.corrcoef([1, 4, 2, 3], [2, 5, 4, 3])[0, 1])
    assert got.jaccard_pass and got.pearson_pass and got.overall_pass
    same = E.rater_agreement(rows.where("a = 4 or a = 2").selectExpr("j", "a", "1 AS b"), "j", "a", "b").first()
    assert same.pearson is None and same.jaccard_pass and not same.pearson_pass and not same.overall_pass
    none = E.rater_agreement(rows.limit(0), "j", "a", "b").first()
    assert (none.n, none.mean_jaccard, none.median_jaccard, none.least, none.pearson, none.overall_pass) == (0, 0.0, 0.0, 0.0, None, False)


def test_resamples_cost_a_row_a_piece(spark, monkeypatch):
    """Values aren't copied for each block of resamples, nor do they carry the sizes of all pieces."""
    df = spark.createDataFrame([("a", float(v)) for v in range(300)], ROWS)
    monkeypatch.setattr(R, "PIECE", 20)
    pieces, shares = R._pieces(df, "g", "x")
    assert pieces.columns == ["grp", "x", "n", "piece"] and pieces.count() == 300 and shares.count() == 15 * 15
    plan = R.resampled_means(df, "g", "x", 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_draws_have_one_law_either_way():
    x, taken = np.array([1.0, 5.0, 6.0, 20.0]), np.full(4000, 50)
    for n in ([1, 1, 1, 1], [100, 100, 100, 100], [3, 1, 2, 1], [300, 100, 200, 100]):
        n, sums = np.array(n, float), R._sums(np.random.default_rng(1), x, np.array(n, float), taken)
        mean = (n @ x) / n.sum()
        sd = math.sqrt(50 * ((n @ x**2) / n.sum() - mean**2))
        assert abs(sums.mean() - 50 * mean) < 5 * sd / math.sqrt(4000) and 0.95 < sums.std() / sd < 1.05
