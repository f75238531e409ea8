"""Separation of kinds against plain loops over pairs."""

import itertools
import math
import statistics

import pytest

from ledgerline.operators import separation as S

VECTORS = "kind string, embedding array<double>"


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 1.0 if na == 0 or nb == 0 else sum(x * y for x, y in zip(a, b, strict=True)) / na / nb


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute(rows, kind, similar):
    own = [v for k, v in rows if k == kind and v is not None]
    rest = [v for k, v in rows if k != kind and v is not None]
    intra = [similar(a, b) for a, b in itertools.combinations(own, 2)]
    cross = [similar(a, b) for a in own for b in rest]
    of = lambda xs: (statistics.mean(xs), statistics.pstdev(xs)) if xs else (0.0, 0.0)
    return (len(own), len(intra), *of(intra), len(cross), *of(cross))


ROWS = [("code", [1.0, 0.2, 0.0]), ("code", [0.9, 0.3, 0.1]), ("code", [0.0, 0.0, 0.0]), ("code", [2.0, 0.1, -0.4]), ("code", [0.0, 0.0, 0.0]), ("code", None),
        ("prose", [-0.3, 1.0, 0.5]), ("prose", [-0.2, 0.8, 0.9]), ("prose", [0.0, 0.0, 0.0]), ("one", [0.0, 0.0, 3.0]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]


@pytest.mark.parametrize("unit", [True, False])
def test_spreads(spark, monkeypatch, unit):
    """Zero vectors, a group of one, a null group, copies; also when tasks hand on early and moments come in pieces."""
    df = spark.createDataFrame(ROWS, VECTORS).repartition(3)
    for held, wide in ((S.HELD, S.WIDE), (1, 2)):
        monkeypatch.setattr(S, "HELD", held)
        monkeypatch.setattr(S, "WIDE", wide)
        got = {r.kind: tuple(r)[1:] for r in S.cosine_spreads(df, "kind", unit=unit).collect()}
        assert set(got) == {"code", "prose", "one", None}
        for kind, values in got.items():
            assert values == pytest.approx(brute(ROWS, kind, cosine if unit else inner), abs=1e-7), kind
    assert S.cosine_spreads(df.limit(0), "kind").count() == 0


def test_sigmas(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, -1.0]), ("c", [0.1, -1.0])]
    spreads = S.cosine_spreads(spark.createDataFrame(rows, VECTORS), "kind")
    kinds = {r.kind: r for r in S.kind_sigma(spreads).collect()}
    _, _, im, isd, _, cm, csd = brute(rows, "c", cosine)
    assert kinds["c"].sigma == pytest.approx(abs(im - cm) / math.sqrt((isd**2 + csd**2) / 2)) and kinds["c"].fit == (kinds["c"].sigma >= 3)
    clusters = {r.kind: r for r in S.duplicate_sigma(spreads).collect()}
    assert set(clusters) == {"a", "c"}  # no cluster of one
    assert clusters["c"].sigma == pytest.approx((im - cm) / csd)
    alone = {r.kind: r for r in S.duplicate_sigma(S.cosine_spreads(spark.createDataFrame(rows[:3], VECTORS), "kind")).collect()}
    assert alone["a"].sigma == math.inf and alone["a"].fit  # unrelated pairs are all alike
    still = {r.kind: r for r in S.kind_sigma(S.cosine_spreads(spark.createDataFrame(rows[:3], VECTORS), "kind")).collect()}
    assert still["a"].sigma == 0 and not still["a"].fit


def test_searches_pass_over_cells_that_hold_no_hit(spark, monkeypatch):
    """Same pairs as plain loops; of clustered vectors most cells are never met."""
    import numpy as np

    from ledgerline.operators import vectors as V

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12))
    rows = [(i, (centres[i % 20] + 0.15 * rng.normal(size=12)).tolist()) for i in range(600)] + [(900, [0.0] * 12), (901, None)]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = corpus.where("id % 20 = 0 or id >= 900").selectExpr("id AS qid", "vec AS qvec")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and any(v)}
    for block in (50_000, 7):
        monkeypatch.setattr(V, "BLOCK", block)
        for least in (0.5, 0.97):
            got = {(r.qid, r.id): r.cosine for r in V.pairs_above(corpus, queries, least).collect()}
            want = {(q, i): float(unit[q] @ unit[i]) for q in unit if q % 20 == 0 for i in unit if i != q and unit[q] @ unit[i] >= least}
            assert got == pytest.approx(want) and len(got) > 20
    monkeypatch.setattr(V, "BLOCK", 50_000)
    left, right = V.cells_by_pivots(corpus, queries, 0.97)
    cells, met = left.select("cell").distinct().count(), right.select("qid", "cell").distinct().count()
    assert met < 0.4 * cells * 30
    assert V.pairs_above(corpus.limit(0), queries, 0.9).count() == 0 and V.pairs_above(corpus, queries.limit(0), 0.9).count() == 0
