import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import gates, history


def test_gates(spark):
    df = spark.createDataFrame([(3.9, "block", "warn"), (4.0, "deny", "shadow"), (6.0, "deny", "strict"), (9.0, "block", "off")], "s double, v string, m string")
    assert [tuple(r) for r in df.select(gates.drift_gate(F.col("s")), gates.downgraded(F.col("v"), F.col("m"))).collect()] == [("allow", "warn"), ("warn", "shadow"), ("deny", "deny"), ("deny", "allow")]
    one = spark.range(1)
    vec = one.select(gates.risk_vector(F.array(*[F.lit(10.0)] * 8), F.lit(False)).alias("a"), gates.risk_vector(F.array(*[F.lit(10.0)] * 8), F.lit(True)).alias("b")).first()
    assert vec.a == [0.5, 1.0, 10 / 12, 0.25, 0.05, 0.25, 1.0, 1.0] and vec.b == [0.0] * 7 + [1.0]
    m = lambda **kw: F.create_map(*[F.lit(x) for p in kw.items() for x in p])
    got = one.select(gates.fired(m(a=2.0, b=1.0, c=9.0), m(a=1.5, b=1.0)).alias("f"), gates.manifest_changes(m(a="1", b="2"), m(a="1", c="3")).alias("d"), gates.redacted_config(m(Api_Key="x", n="1")).alias("r")).first()
    assert got.f == {"a": 0.5} and set(got.d) == {"b", "c"} and got.r == {"Api_Key": "[REDACTED]", "n": "1"}
    steps = one.select(gates.process_gate(F.lit(1), F.lit(5)), gates.process_gate(F.lit(0), F.lit(0)), gates.regression_gate(F.lit(1))).first()
    assert tuple(steps) == ("warn", "allow", "block")


def test_session_outcomes(spark):
    rows = [(0, 0), (0, 2), (1, 0), (1, 3), (2, 0), (-9, 0), (None, 0), (0, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "c int, m int").select(history.session_outcome(F.col("c"), F.col("m"))).collect()]
    assert got == ["clean", "infrastructure", "gap", "gap", "infrastructure", "infrastructure", "infrastructure", "clean"]


def test_judged_outcomes(spark):
    rows = [("a", 4), ("a", 5), ("a", 1), ("b", 2), ("b", 3), ("c", 5), ("c", 1), ("d", 3), ("e", None), ("f", 5), ("f", 2), ("f", 3), ("f", 4), ("f", 1)]
    got = {r.k: (r.n_high, r.n_low, r.resolved, r.regressed) for r in history.judged_outcome(spark.createDataFrame(rows, "k string, s int"), "k", "s").collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (0, 1, 0, 1), "c": (1, 1, 0, 0), "d": (0, 0, 0, 0), "e": (0, 0, 0, 0), "f": (2, 2, 0, 0)}


def test_embedder_gates(spark):
    nan = float("nan")
    rows = [
        (1, "old", 0.60, 0.92, 10.0), (1, "new", 0.72, 0.87, 25.0), (1, "random", 0.50, None, None),
        (2, "old", 0.68, 0.92, 10.0), (2, "new", 0.72, 0.90, 26.0), (2, "random", 0.56, 0.1, 1.0),
        (3, "old", nan, 0.92, 0.0), (3, "new", 0.70, nan, 1.0),
    ]
    got = gates.embedder_gates(spark.createDataFrame(rows, "run int, backend string, auc double, anisotropy double, latency_ms double"), "run", "old", "new", "random").collect()
    passed = {k: [r.gate for r in got if r.run == k and r.passed] for k in (1, 2, 3)}
    assert passed == {1: list(gates.EMBEDDER_GATES), 2: ["candidate_auc"], 3: ["candidate_auc", "falsifiability"]}
    assert next(r.observed for r in got if r.run == 3 and r.gate == "auc_inversion") is None and len(got) == 15


def test_plan_novelty(spark):
    """Against the eight newest before it, by plain loops."""
    rng = random.Random(3)
    rows = [("p", t // 2, t, [rng.gauss(0, 1), rng.gauss(5, 1)]) for t in range(14)] + [("q", t, t, [0.0, 0.0]) for t in range(5)] + [("r", t, t, [1.0, 0.0] if t < 4 else [2.0, 0.0]) for t in range(5)]
    plans = spark.createDataFrame(rows, "project string, ts long, plan long, v array<double>")
    got = {(r.project, r.plan): r for r in gates.plan_novelty(plans, "project", "ts", "plan", "v").collect()}
    assert len(got) == len(rows)
    for project, _, plan, v in rows:
        peers = [x for p, _, k, x in rows if p == project and k < plan][-8:]
        r = got[project, plan]
        assert r.peer_count == len(peers)
        if len(peers) < 3 or project == "q":
            assert r.ratio is None and r.drift is None and r.far is None
            continue
        centre = [sum(x) / len(peers) for x in zip(*peers, strict=True)]
        middle = statistics.median(math.dist(x, centre) for x in peers)
        denom = max(middle, 0.05 * statistics.median(math.hypot(*x) for x in peers))
        assert (r.drift, r.peer_median, r.denom) == pytest.approx((math.dist(v, centre), middle, denom))
        assert r.ratio == pytest.approx(math.dist(v, centre) / denom) and r.far == (r.ratio > 1.8)
    assert got["r", 4].ratio == pytest.approx(20) and got["r", 4].far
