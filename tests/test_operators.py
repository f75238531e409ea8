"""Operators without SQL, on small fixtures."""

import datetime as dt
import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import code
from ledgerline.operators import calibration, decisions, experiments, graph, history, paths, rules, texts, vectors
from ledgerline.plans import rule_queries
from ledgerline.sources import logs
from ledgerline.streaming import state


def test_check_goes_to_the_group_that_has_ended(spark):
    """A group that is still being edited after the check doesn't get it, though it has earlier edits."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    edits = spark.createDataFrame([(1, "f", 1, at(1)), (1, "f", 1, at(3)), (1, "f", 2, at(2)), (1, "f", 2, at(9))], "session_id long, file_path string, group_id long, ts timestamp")
    checks = spark.createDataFrame([(7, 1, "f", at(5)), (8, 1, "f", at(9)), (9, 1, "f", at(0)), (10, 2, "f", at(9))], "check_id long, session_id long, file_path string, ts timestamp")
    assert {r.check_id: r.group_id for r in decisions.check_to_group(edits, checks).collect()} == {7: 1, 8: 2, 9: None, 10: None}


def test_retry_holds_at_the_last_second(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 1, "f", at(0), "block"), (2, 1, "f", at(120), "allow"), (3, 1, "f", at(121), "allow"), (4, 1, "g", at(1), "allow"), (5, 2, "f", at(1), "allow")]
    log = spark.createDataFrame(rows, "decision_id long, session_id long, file_path string, ts timestamp, decision string")
    assert {r.decision_id: r.retry_after_block for r in decisions.with_retry(log).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_zero_vectors_have_two_rules(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.cosine(a, b).alias("c"), vectors.cosine_unit(a, b).alias("u"), vectors.chord(a, b).alias("d")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, 2.0), (1.0, 0.0, 0.0), (0.0, 0.0, pytest.approx(math.sqrt(2)))]


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([([1.0, float(i), None if i == 0 else 2.0 * i],) for i in range(5)], "v array<double>")
    got = {(r.i, r.j): r.r for r in vectors.correlations(df, "v", 3).collect()}
    assert got[0, 1] is None and got[1, 2] == pytest.approx(1.0)


def test_auc_counts_ties_half(spark):
    rng = random.Random(1)
    rows = [(float(rng.randint(0, 9)), rng.random() < 0.4) for _ in range(200)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "s double, p boolean")
    assert experiments.auc(df, "s", "p").first().auc == pytest.approx(want)
    assert math.isnan(experiments.auc(df.where("p"), "s", "p").first().auc) and math.isnan(experiments.auc(df.limit(0), "s", "p").first().auc)


def test_exact_bounds_and_tests():
    low, high = experiments.exact_bounds(3, 20, 0.025)
    tail = lambda p, ks: sum(math.comb(20, k) * p**k * (1 - p) ** (20 - k) for k in ks)
    assert tail(low, range(3, 21)) == pytest.approx(0.025) and tail(high, range(4)) == pytest.approx(0.025)
    assert experiments.exact_bounds(0, 20, 0.025)[0] == 0 and experiments.exact_bounds(20, 20, 0.025)[1] == 1
    assert experiments.sign_test_p(0, 0, "two-sided") == 1 and experiments.sign_test_p(8, 0, "two-sided") == pytest.approx(2 / 256) and experiments.sign_test_p(3, 3, "two-sided") == 1
    r = experiments.rate_ratio(0, 150, 133, 150, 0.05)
    assert r["ratio"] == 0 and 0.02 < r["high"] < 0.05 and experiments.difference_bound(137, 150, 17, 150, 0.05) > 0.6
    low, high = experiments.bca([0.1 * i for i in range(20)], 500)
    assert low < 0.95 < high and all(map(math.isnan, experiments.bca([])))
    low, high = experiments.kappa_interval([(1, 1)] * 20 + [(0, 0)] * 20 + [(1, 0)] * 4)
    assert low < 0.82 < high and all(map(math.isnan, experiments.kappa_interval([(1, 1)] * 5)))


def test_wilcoxon_and_holm(spark):
    deltas = [1.0, 2.0, 2.0, -1.0, 3.0, 0.0, 5.0, 4.0, -2.0, 6.0]
    got = experiments.wilcoxon(spark.createDataFrame([("m", d) for d in deltas], "m string, d double"), ["m"], "d").first()
    assert (got.n, got.w) == (9, 5.5) and 0.04 < got.p < 0.06
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", float("nan"))]
    adjusted = {r.k: r.p_holm for r in experiments.holm(spark.createDataFrame(rows, "k string, p double").withColumn("g", F.lit(1)), ["g"], "p").collect()}
    assert adjusted == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None, "e": None}


def test_majority_takes_the_first_seen_of_equals(spark):
    rows = [([1, 0, 1],), ([0, 1, 1, 0],), ([None, 1],), ([None, None],), ([2, None, 2],), ([],)]
    assert [r.m for r in spark.createDataFrame(rows, "v array<int>").select(experiments.majority(F.col("v")).alias("m")).collect()] == [1, 0, None, None, 2, None]


def test_calibration_against_plain_algebra(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) @ np.diag([1, 2, 3, 4.0])
    c = x - x.mean(axis=0)
    s = c.T @ c / 60
    mu = np.trace(s) / 4
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 60**2
    share = min(1, noise / ((s - mu * np.eye(4)) ** 2).sum())
    assert np.allclose(calibration.shrunk_covariance(x), (1 - share) * s + share * mu * np.eye(4))
    assert np.isinf(calibration.distances(x, x.mean(axis=0), np.zeros((4, 4)))).all() and calibration.leave_one_out(x[:30]) > 0
    for part in (x[:30], x[:2], np.ones((5, 2)), 1e3 + x[:40]):
        each = [np.delete(part, i, axis=0) for i in range(len(part))]
        plain = [calibration.distances(part[i : i + 1], r.mean(axis=0), calibration.inverse(calibration.shrunk_covariance(r)))[0] for i, r in enumerate(each)]
        assert calibration.leave_one_out(part) == pytest.approx(calibration.quantile(plain, 0.95), rel=1e-6)
    assert calibration.quantile([1.0, 2.0, math.inf], 0.5) == 2.0 and calibration.quantile([math.inf] * 3, 0.9) == math.inf and calibration.quantile([1.0, 3.0], 0.25) == 1.5
    rows = [("a", r.tolist()) for r in x[:50]] + [("b", r.tolist()) for r in x[:49]]
    df = spark.createDataFrame(rows, "kind string, v array<double>")
    models = calibration.fit_kinds(df, "kind", "v")
    got = {r.kind: r for r in models.collect()}
    assert got["a"].n == 50 and got["b"].n == 49 and got["a"].low <= got["a"].high
    scored = calibration.score(df, models, "kind", "v").where("kind = 'b'").collect()
    own = [float(calibration.distances(np.array([r.v]), np.array(got["b"].mean), np.array(got["b"].inverse))[0]) for r in scored]
    assert [r.distance for r in scored] == pytest.approx(own)
    assert calibration.fit_kinds(df.limit(0), "kind", "v").count() == 0 and calibration.fit_kinds(df.limit(49), "kind", "v").count() == 0
    whole = calibration.fit(np.array([r[1] for r in rows]))  # what a kind of 49 rows falls back to
    assert got["b"].threshold == pytest.approx(whole["threshold"]) and got["b"].mean == pytest.approx(whole["mean"].tolist())
    power = calibration.drift_levels(spark, 30, 0.1, 0.25, 40).first()
    assert power.power > power.type_i


def test_cycles_are_peeled_out(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    got = graph.on_cycles(edges([(1, 2), (2, 3), (3, 1), (0, 1), (3, 9), (9, 10)])).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 3), (3, 1)]
    assert graph.on_cycles(edges([(i, i + 1) for i in range(20)])).count() == 0
    shape = graph.degrees(edges([(1, 2), (1, 3), (1, 2)])).first()
    assert (shape.n_edges, shape.max_out, shape.max_in, shape.isolated_share) == (2, 2, 1, 0.0)


def test_two_glob_dialects():
    import re

    hit = lambda f, g, p: bool(re.search(f(g), p))
    assert hit(paths.path_glob, "src/*.py", "src/a/b.py") and hit(rules.scope_glob, "src/*.py", "src/a/b.py") and not hit(paths.path_glob, "src/**/*.py", "src/b.ts")
    assert hit(paths.path_glob, "src/**/*.py", "src/b.py") and hit(paths.path_glob, "a.py", "/home/x/a.py") and not hit(paths.path_glob, "/a.py", "/x/a.py")
    assert not hit(paths.path_glob, "a.py", "x/a.py") and hit(paths.path_glob, "**/a.py", "x/a.py") and hit(paths.path_glob, "docs/**", "docs")
    assert hit(rules.scope_glob, "[!a]x", "bx") and not hit(rules.scope_glob, "[!a]x", "ax")


def test_rules_bypass_and_position(spark):
    rows = [(1, "a.py", "import os\nx = eval(y)", ["os"]), (2, "a.py", "# rc:skip-rule:no-eval\neval(y)", ["osx"]), (3, "a.ts", "eval(y)", ["os.path"])]
    df = spark.createDataFrame(rows, "edit_id long, path string, source string, imports array<string>")
    rs = [{"id": "no-eval", "type": "forbid_pattern", "pattern": r"\beval\(", "severity": "block"}, {"id": "no-os", "type": "forbid_import", "target": "os", "language": "python"}]
    assert sorted((r.edit_id, r.rule_id) for r in rules.apply_rules(df, rs).collect()) == [(1, "no-eval"), (1, "no-os"), (3, "no-eval")]
    assert rules.apply_rules(df, []).count() == 0
    line, col = rules.position(F.col("source"), r"\beval\(")
    assert [tuple(r) for r in df.select(line, col).collect()] == [(2, 4), (2, 0), (1, 0)]
    mode = spark.createDataFrame([("# rc:skip-mock why\nx",), ("x\n" * 20 + "# rc:skip",), (None,)], "s string").select(rules.directive(F.col("s")).alias("m")).collect()
    assert [tuple(r.m) for r in mode] == [("skip-mock", "why", 1), (None, None, None), (None, None, None)]


SOURCE = '''import os, a.b
from . import c
def first(x: int, y=2) -> int:
    """Text."""
    for i in range(x):
        if i > y and x:
            print(i, os.name)
    return y + 10
'''


def test_code_functions():
    assert code.imports_of(SOURCE) == [".", "a.b", "os"] and code.imports_of("import {x} from 'mod'; require('y')") == ["mod", "y"]
    assert code.branches(SOURCE) == 3 and code.branches("def (") == 0 and code.depth("x = 1") > 1
    assert code.calls(SOURCE) == {"first": {"range", "print"}}
    tokens = code.logic_tokens(SOURCE)
    assert tokens == ["N:range", "K:>", "N:print", "N:os", "N:name", "K:+"]
    renamed = code.logic_tokens(SOURCE.replace("x", "zz").replace("i ", "k ").replace("(i", "(k"))
    assert tokens == renamed and code.sequence_ratio([], []) == 1.0 and code.sequence_ratio([], ["a"]) == 0.0
    assert [f[:2] for f in code.functions_of(SOURCE)] == [("first", 3)]
    nested = "é = 1\nclass A:\n    def méthode(self):\n        def inner():\n            return 'a string that is long enough é'\n        return inner\nx = 1; f = lambda: 0\n"
    import ast

    plain = [(n.name, n.lineno, ast.get_source_segment(nested, n)) for n in ast.walk(ast.parse(nested)) if isinstance(n, ast.FunctionDef)]
    assert code.functions_of(nested) == [p for p in sorted(plain, key=lambda p: p[1]) if len(p[2]) >= 40] != []
    assert code.metrics(nested)["functions"] == [p[0] for p in code.functions_of(nested)] and code.metrics("def (") == {**code.metrics("def ("), "branches": 0, "compiles": False}
    for n, k, p in ((50, 3, 0.2), (50, 40, 0.2), (9, 0, 0.5), (400, 399, 0.9)):
        assert experiments._binomial_cdf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-10)
    assert code.tree_distance(SOURCE, SOURCE.replace("10", "11")) == 2 and code.tree_distance("a(", "b(") == 2
    text = "é = 1\n" * 70 + SOURCE
    spans = code.chunks(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text.encode()) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert code.chunks("") == [] and code.changed_lines("a\nb\n", "a\nc\nd\n") == [2, 3]
    assert code.changed_bytes("é\nb\n", "é\nc\n") == [(3, 5)] and code.chunk_weights([False, True, False, False]) == pytest.approx([1 / 6, 4 / 6, 1 / 6, 0])
    assert np.linalg.norm(code.pooled([[3.0, 0.0], [0.0, 4.0]], [0.5, 0.5])) == pytest.approx(1)


def test_edits_and_diffs():
    assert code.apply_edit("edit", "a b a", {"old": "a", "new": "c"}) == "c b a" and code.apply_edit("edit", "x", {"old": "a", "new": "c"}) is None
    assert code.apply_edit("multi", "a", {"edits": [{"old": "a", "new": "b"}, {"old": "b", "new": "c"}]}) == "c" and code.apply_edit("write", None, {"content": "w"}) == "w"
    good = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n x\n-y\n+z"
    assert code.diff_errors(good) == [] and code.diff_errors(good.replace("1,2 @@", "1,3 @@")) == [(3, "count_mismatch")]
    assert code.repair_diff(good.replace("1,2 @@", "1,3 @@")) == good and code.diff_errors("@@ -1 +1 @@\n-a\n+b") == []


def test_code_udfs(spark):
    code.register(spark)
    df = spark.createDataFrame([(SOURCE,), ("def (",), (None,)], "s string")
    df.createOrReplaceTempView("sources")
    got = spark.sql("SELECT code_branches(s) AS b, code_compiles(s) AS ok, code_imports(s) AS i FROM sources").collect()
    assert [(r.b, r.ok, r.i) for r in got] == [(3, True, [".", "a.b", "os"]), (0, False, []), (0, True, [])]
    assert spark.sql("SELECT f.name FROM sources, LATERAL code_functions(s) f WHERE s IS NOT NULL").collect()[0].name == "first"
    assert code.control_embedding(["a", "b"]) == code.control_embedding(["a", "b"]) and code.control_embedding([]) == [0.0] * 64


def test_text_functions(spark):
    rows = [("x Bearer abcdefgh1 sk-abcdefghijkl", "home/.env", 3, "h", ["a.py", "my-secret.txt"]), ("Password = x y", "a.py", 5, "h", None), (None, None, 7, "h", [])]
    df = spark.createDataFrame(rows, "reason string, file_path string, after_bytes int, before_sha256 string, changed_files array<string>").withColumn("a.b", F.lit(1))
    got = [tuple(r)[:5] for r in texts.redact_rows(df).collect()]
    assert got == [("x [REDACTED] [REDACTED]", "[REDACTED]", 0, None, ["a.py", "[REDACTED]"]), ("[REDACTED] y", "a.py", 5, "h", None), (None, None, 7, "h", [])]
    new = spark.createDataFrame([("f", "x"), ("f", "x"), ("g", "y"), ("h", "z")], "name string, body string")
    old = spark.createDataFrame([("f", "x"), ("k", "y")], "name string, body string")
    assert sorted(map(tuple, texts.duplicate_definitions(new, old).collect())) == [("f", "x"), ("g", "y")]


def test_log_source_and_sink(spark, tmp_path):
    today, root = dt.date(2024, 3, 5), str(tmp_path / "log")
    row = lambda i: {"decision_id": f"d{i}", "ts": f"2024-03-0{i}T00:00:00Z", "decision": "allow", "latency_ms": i, "unknown": 1}
    for i in (1, 4, 5):
        path = logs.write_session(root, f"2024-03-0{i}", "s", [row(i)], packed=i == 4)
    with open(path, "a") as f:
        f.write("not json\n")
    every = logs.read_log(spark, root)
    assert sorted(r._corrupt is None for r in every.select("decision_id", "_corrupt").collect()) == [False, True, True, True]
    last = logs.read_log(spark, root, today, 2).where("_corrupt is null")
    assert sorted(r.decision_id for r in last.collect()) == ["d4", "d5"] and str(last.select(F.max("day")).first()[0]) == "2024-03-05"
    assert logs.find_decision(every, "d4").first().latency_ms == 4
    upgraded = logs.upgrade(every).first()
    assert upgraded.host == "unknown" and upgraded.schema_version == 4
    logs.append_log(last.drop("_corrupt"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "labels.jsonl").write_text("\n".join(json.dumps({"decision_id": "d1", "labels": {"ok": True, "bad": False}}) for _ in range(2)))
    assert logs.read_labels(spark, str(tmp_path / "labels.jsonl")).count() == 1
    assert [tuple(r) for r in logs.label_counts(spark, str(tmp_path / "labels.jsonl"), 5).collect()] == [("ok", 2, 3)]
    files = spark.createDataFrame([("a", dt.date(2024, 3, 5), 6), ("b", dt.date(2024, 3, 4), 5), ("c", dt.date(2023, 1, 1), 1)], "path string, modified date, size long")
    assert {r.path: r.keep for r in logs.retained(files, "2024-03-05", cap=10).collect()} == {"a": True, "b": False, "c": False}


def test_tree_result_and_commit_sources(spark, tmp_path):
    tree = tmp_path / "proj"
    for p in ("a.py", "tests/test_a.py", "node_modules/x.py", ".git/y.py", "b.txt"):
        (tree / p).parent.mkdir(parents=True, exist_ok=True)
        (tree / p).write_text("x = 1")
    got = logs.read_tree(spark, str(tree), ["py", "ts"])
    assert sorted(r.path for r in got.collect()) == ["a.py", "tests/test_a.py"] and logs.scan_tests(got).count() == 1
    res = tmp_path / "res"
    res.mkdir()
    for name, body in {"1.json": {"task_id": "t", "arm": "a", "resolved": False}, "2.json": {"task_id": "t", "arm": "a", "resolved": True}, "report.json": {"task_id": "r", "arm": "a"}, "3.json": {"arm": "a"}}.items():
        (res / name).write_text(json.dumps(body))
    assert [(r.task_id, r.resolved) for r in logs.read_results(spark, str(res)).collect()] == [("t", True)]
    log = "".join(f"\x1esha{i}\x1fann\x1f2024-01-01\x1fsubject {i} é\nf{i}.py\ng.py\n\n" for i in range(200))
    (tmp_path / "commits.txt").write_text(log)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for block in ("64b", "1000b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            rows = logs.read_commits(spark, str(tmp_path / "commits.txt")).collect()
            assert sorted(r.sha for r in rows) == sorted(f"sha{i}" for i in range(200)) and all(len(r.files) == 2 for r in rows)
            assert {r.subject for r in rows} == {f"subject {i} é" for i in range(200)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_streams_agree_with_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 2), f"f{rng.randint(0, 1)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=40 * i), rng.choice(["block", "allow", "warn"]), "s", rng.randint(0, 99), i % 3) for i in range(60)]
    schema = "decision_id long, session_id long, file_path string, ts timestamp, decision string, signal_source string, latency_ms long, checksum long"
    log = spark.createDataFrame(rows, schema)
    for k, (lo, hi) in enumerate(((0, 30), (30, 60))):
        log.where((F.col("decision_id") >= lo) & (F.col("decision_id") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return spark.table(name).collect()

    streamed = {r.decision_id: r.retry_after_block for r in run(state.retries(src), "retries", "append")}
    assert streamed == {r.decision_id: r.retry_after_block for r in decisions.with_retry(log).collect()}
    marks, want = {}, {}
    for i, _, file, when, *_, checksum in rows:
        mark = marks.get((file, checksum))
        want[i] = mark is not None and (when - mark).total_seconds() < 200
        if not want[i]:
            marks[file, checksum] = when
    assert {r.decision_id: r.repeated for r in run(state.suppressed(src, 200_000), "suppressed", "append")} == want and any(want.values())
    assert max(r.n for r in run(state.history(src, keep=5), "history", "update")) == 5
    rates = {r.window.start.hour: (r.n, r.rate) for r in run(state.windowed_rate(src, "10 minutes"), "rates", "update") if r.window.start.minute == 0}
    first = [r for r in rows if r[3] < dt.datetime(2024, 1, 1, 0, 10)]
    assert rates[0] == (len(first), pytest.approx(sum(r[4] == "block" for r in first) / len(first)))


def test_late_blocks_do_not_set_the_time_back(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "decision_id long, session_id long, file_path string, ts timestamp, decision string"
    for k, rows in enumerate(([(1, 1, "f", at(300), "block")], [(2, 1, "f", at(100), "block"), (3, 1, "f", at(90), "allow")], [(4, 1, "f", at(380), "allow")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = state.retries(src).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r.decision_id: r.retry_after_block for r in spark.table("late").collect()} == {1: False, 2: False, 3: False, 4: True}


def test_findings_escalate_and_stick(spark):
    assert state.review_state(["seen"] + ["stop"] * 3) == ("open", 3) and state.review_state(["seen"] + ["stop"] * 9) == ("escalated", 3)
    assert state.review_state(["seen", "defer", "stop", "seen"]) == ("deferred", 0) and state.review_state(["seen", "stop", "resolve", "stop"]) == ("resolved", 1)
    assert state.review_state(["seen", "stop", "gone", "seen", "stop"]) == ("open", 1) and state.review_state(["stop", "defer"]) == ("new", 0) and state.review_state(["seen", "stop", "seen"]) == ("open", 1)
    df = spark.createDataFrame([(1, 2, "resolve"), (1, 1, "seen"), (2, 1, "seen"), (2, 2, "defer")], "finding_id long, seq long, event string")
    assert {r.finding_id: r.status for r in state.reviews(df).collect()} == {1: "resolved", 2: "deferred"}


def test_only_edges_on_cycles_are_left(spark):
    """Chains of any length, tails, and bridges between cycles lie on none; the rounds and the last task agree with brute force."""
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    found = lambda rows, **kw: sorted(map(tuple, graph.on_cycles(edges(rows), **kw).collect()))
    chain = [(i, i + 1) for i in range(300)]
    assert found(chain) == found(chain[:12], at_once=0) == found([]) == []
    assert found([*chain, (300, 299), (7, 7)]) == [(7, 7), (299, 300), (300, 299)]
    bridge = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 1), (4, 6), (None, 1), (2, 2), (1, 2)]
    assert found(bridge) == found(bridge, at_once=0) == [(1, 2), (2, 1), (2, 2), (3, 4), (4, 3)]
    assert len(found([*chain, (300, 0)])) == 301
    rng = random.Random(2)
    for n, m in ((12, 14), (40, 55), (60, 200)):
        some = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {v: set() for v in range(n)}
        for _ in range(n):
            for a, b in some:
                reach[a] |= {b} | reach[b]
        want = sorted((a, b) for a, b in some if a == b or a in reach[b])
        assert found(list(some)) == want
        if n < 60:
            assert found(list(some), at_once=0) == want


def test_graph_queries_take_whole_tables(spark, tmp_path):
    """Lines of any quantity and parts of any key are edges."""
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    # supplier 2 has part 2001, supplier 2001 has part 2: a cycle, of small quantities; 1001 isn't 1
    lines = [(1, 2, 2001, 1.0), (2, 2, 2001, 30.0), (3, 2001, 2, 2.0), (4, 3, 1001, 3.0), (5, 3, 1, 50.0)]
    table("lineitem", lines, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double")
    table("supplier", [(2,), (3,), (4,), (2001,)], "s_suppkey long")
    table("part", [(1,), (2,), (1001,), (2001,), (9,)], "p_partkey long")
    shape = rule_queries.call_graph_shape(spark, str(tmp_path)).first()
    assert (shape.n_edges, shape.max_in, shape.max_out, shape.n_nodes, shape.isolated_share) == (4, 1, 2, 7, round(2 / 7, 6))
    assert {r.module: r.n_files for r in rule_queries.import_fan_in(spark, str(tmp_path)).collect()} == {2: 2, 3: 2, 4: 0, 2001: 1}
    assert sorted(map(tuple, rule_queries.import_cycles(spark, str(tmp_path)).collect())) == [(2, 2001), (2001, 2)]


def test_copies_keep_their_weight_in_a_fit(spark):
    """A third of a kind's 30,000 rows are copies of one vector: all rows count, as in plain linear algebra."""
    x = np.random.default_rng(8).normal(size=(30_000, 3)) @ np.diag([1, 2, 3.0])
    x[:10_000] = [3.0, -4.0, 5.0]
    df = spark.createDataFrame(pd.DataFrame({"kind": "a", "v": x.tolist()}), "kind string, v array<double>")
    got = calibration.fit_kinds(df, "kind", "v").first()
    want = calibration.fit(x, resamples=200)
    assert got.n == 30_000 and np.allclose(got.mean, want["mean"]) and np.allclose(got.inverse, want["inverse"])
    assert got.threshold == pytest.approx(want["threshold"]) and got.low <= got.threshold <= got.high
    assert (got.low, got.high) == pytest.approx((want["low"], want["high"]), rel=0.02)


def test_each_pair_with_a_partner_gets_the_next_one(spark):
    """All that have a pair of another commit and file in the table get the next of them, round the end; 80 % clash."""
    rng = random.Random(4)
    rows = [(i, "big" if rng.random() < 0.6 else f"s{rng.randrange(9)}", "py" if rng.random() < 0.6 else f"f{rng.randrange(9)}") for i in range(700)] + [(700, None, "py"), (701, "s1", None)]
    for table in (rows, rows[:3], [(i, "big", "py") for i in range(40)] + [(40, "s", "f"), (41, "big", "f")]):
        got = {r.id: r.other_id for r in history.shuffled_negatives(spark.createDataFrame(table, "id long, sha string, file string"), "n1").collect()}
        order = sorted((r for r in table if r[1] and r[2]), key=lambda r: (hashlib.md5(f"{r[0]}n1".encode()).hexdigest(), r[0]))
        want = {}
        for i, (id_, sha, file) in enumerate(order):
            found = [o for o, s, f in order[i + 1 :] + order[:i] if s != sha and f != file]
            if found:
                want[id_] = found[0]
        assert got == want


def test_severity_classes(spark):
    rows = [
        ("plan_impl_drift", "blocked", None, "plan_grounding"), ("plan_impl_drift", "shadow_blocked", None, "shadow"), ("contract_violation", "Fail-Open", "rules", "fail_open"),
        ("x", "operator_override", None, "override"), ("CONTRACT_VIOLATION:oracle", "blocked", None, "contract"), ("oracle_ruff", "warn", None, "oracle"), ("rule_engine:r1", "warn", None, "rule_engine"),
        ("my rule_engine:r1", "warn", None, "other"), ("shell_escape", "blocked", "rules", "self_protection"), ("kill_switch_set", "blocked", None, "self_protection"),
        ("magic_comment", "blocked", None, "self_protection"), ("planless", "blocked", "rules", "plan_grounding"), (None, None, "plan_grounding", "plan_grounding"), ("", "blocked", "rules", "rule_engine"), (None, "allowed", None, "other"),
    ]
    df = spark.createDataFrame(rows, "reason string, decision string, gate string, want string")
    assert [r.got for r in df.select(decisions.severity(F.col("reason"), F.col("decision"), F.col("gate")).alias("got")).collect()] == [r[3] for r in rows]


def test_pain_categories_and_report(spark):
    rows = [
        ("novelty", "", "allowed", "2024-01-30"), ("x", "EDIT off_plan; gen_timeout", "Exit_Block", "2024-01-29"), (None, None, None, "2024-01-30"),
        ("forbid_import", "forbid_pattern", "warn", "2024-01-30"), ("plan_loc", "loc_budget", "blocked", "2024-01-30"), ("novelty", "", "", "2024-01-01"), ("novelty", "", "", "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, "signal_source string, reason string, decision string, ts string")
    got = [r.c for r in df.select(decisions.pain_categories(F.col("signal_source"), F.col("reason"), F.col("decision")).alias("c")).collect()]
    assert got[:5] == [["2_pattern_blindness"], ["1_scope_creep", "4_token_waste", "7_runtime_enforcement"], [], ["6_hallucinated_apis", "9_repo_conventions"], ["7_runtime_enforcement", "8_over_engineering"]]
    report = {r.category: (r.total, r.today, r.verdict) for r in decisions.pain_report(df, "2024-01-30").collect()}
    assert report["2_pattern_blindness"] == (3, 1, "active") and report["5_local_only_violations"] == (0, 0, "silent") and report["1_scope_creep"] == (1, 0, "weak") and len(report) == 9


def test_efficiency_counts_drift_only(spark):
    rows = [
        (1, "a", "blocked", "plan_impl_drift", False, 500), (2, "a", "blocked", "plan_impl_drift", True, 500), (3, "b", "warn", "plan_impl_drift", True, None), (4, "b", "warn", "plan_impl_drift", False, 0),
        (5, "b", "blocked", "contract_violation", True, 0), (6, "b", "allowed", "plan_impl_drift", None, 0), (7, None, None, "sidecar_unavailable: no", None, 0), (8, "b", "allowed", None, None, 0),
    ]
    log = spark.createDataFrame(rows, "decision_id long, file_path string, decision string, reason string, retry_after_block boolean, latency_ms long")
    links = spark.createDataFrame([("b", 4), ("b", 4), ("z", 1)], "file_path string, decision_id long")
    got = decisions.efficiency(log, links).first()
    assert (got.n_events, got.caught, got.false_drifts) == (8, 4, 2) and got.score == pytest.approx(2 / 2.0 * 0.43 * (1 - 1 / 8))
    assert decisions.efficiency(log.limit(0), links).count() == 0


def test_plan_quality_signals(spark):
    good = "Fix the race condition in src/app.py:42 before release. The endpoint /api/users/{id} needs a lock.\n- Deadlock risk in db/pool.go at line 17"
    vague = "Check edge cases. Verify it works. Make sure tests pass."
    rows = [(1, good), (2, vague), (3, ""), (4, None), (5, " \n\n "), (6, "One sentence. no capital after. Two")]
    q = texts.plan_quality(F.col("t"))
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, t string").select("i", *[c.alias(k) for k, c in q.items()]).collect()}
    assert got[1].ard == pytest.approx(5 / 3) and got[1].nrd == pytest.approx(2 / 3) and (got[1].gpas, got[1].slr, got[1].score, got[1].verdict) == (0.0, 1.0, 1.0, "accept")
    assert (got[2].ard, got[2].gpas, got[2].score, got[2].verdict) == (0.0, 1.0, 0.0, "reject")
    assert all((got[i].score, got[i].verdict) == (0.0, "reject") for i in (3, 4, 5)) and (got[6].score, got[6].verdict) == (0.25, "reject")


def test_mock_ratios(spark):
    rows = [
        (1, "cy.intercept('/api/**', {fixture: 'u'}); cy.intercept('/x', {body: 1}); cy.intercept(`*`, (req) => req.continue({body: 2}))"),
        (2, "jest.mock('a'); sinon.stub(x); axios.get('/y'); const id = 'user-0001', b = 'seed-77777'"),
        (3, "cy.intercept('**', {statusCode: 1}); vi.mock('abcdefg')"), (4, ""), (5, None),
    ]
    seeds = spark.createDataFrame([("x 'seed-77777' y",), (None,)], "text string")
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in texts.mock_ratios(df, seeds).collect()}
    assert (got[1].intercepts, got[1].mocks, got[1].guests) == (pytest.approx(1 / 3), 0.0, 0.0)
    assert (got[2].mocks, got[2].guests, got[2].mocked) == (pytest.approx(2 / 3), 0.5, False)
    assert (got[3].intercepts, got[3].mocks, got[3].guests, got[3].mocked, got[3].authenticity) == (1.0, 1.0, 1.0, True, 0.0)
    assert got[4].mean == got[5].mean == 0.0 and len(got) == 5
    assert {r.guests for r in texts.mock_ratios(df, seeds.limit(0)).collect()} == {0.0}


def test_needles_are_in_every_match():
    samples = {
        r"\bjest\.mock\s*\(": "jest.mock (", r"\bmock\s*\(\s*[A-Z]\w+::class": "mock( Ab::class", r"\bfetch\s*\(\s*['\"]https?://": "fetch('http://", r"\brest\.(?:get|post|put|delete|patch)\s*\(": "rest.put(",
        r"\bhttpx\.(?:get|post|put|delete|patch|Client)\s*\(": "httpx.Client(", r"\bpsycopg\.\w+\.connect\b": "psycopg.x.connect",
    }
    assert set(samples) <= {*texts.MOCK_CALLS, *texts.CLIENT_CALLS}
    assert all(texts._needle(p) in x for p, x in samples.items()) and all(texts._needle(p) in p for p in (*texts.MOCK_CALLS, *texts.CLIENT_CALLS))


def test_sign_test_tails():
    assert experiments.sign_test_p(8, 0) == 1 / 256 and experiments.sign_test_p(7, 1) == 9 / 256 and experiments.sign_test_p(0, 0) == 1.0
    assert experiments.sign_test_p(1, 7, "less") == 9 / 256 and experiments.sign_test_p(1, 7, "two-sided") == 18 / 256
    for k in (480, 500, 530, 700):
        exact = sum(math.comb(1001, i) for i in range(k + 1)) / 2**1001
        assert experiments.sign_test_p(1001 - k, k) == pytest.approx(exact, rel=1e-9)


def test_verdicts_and_samples(spark):
    rows = [(0.15, 0.04, -0.05, 1.5, "ship"), (0.15, 0.05, 0.0, 1.0, "inconclusive"), (0.3, None, 0.0, 1.0, "inconclusive"), (0.3, float("nan"), 0.0, 1.0, "inconclusive"), (-0.05, 0.01, 0.0, 1.0, "inconclusive"), (-0.06, 0.01, 0.0, 1.0, "kill"), (0.3, 0.01, -0.11, 1.0, "kill"), (0.3, 0.01, 0.0, 1.6, "inconclusive")]
    df = spark.createDataFrame(rows, "d double, p double, r double, l double, want string")
    assert [r[0] for r in df.select(experiments.verdict(F.col("d"), F.col("p"), F.col("r"), F.col("l"))).collect()] == [r[4] for r in rows]
    sizes = spark.createDataFrame([(i, i % 9) for i in range(180)] + [(999, None)], "k int, n int")
    got = texts.stratified_sample(sizes, "k", "n", 20, "s").collect()
    assert sorted(r.stratum for r in got) == ["1"] * 6 + ["2-5"] * 6 + ["6+"] * 8 and all(r.n for r in got)
    corpus = spark.createDataFrame([(1, "a", "Run x"), (2, "a", "run-x"), (2, "b", "y")], "id int, s string, b string")
    assert {r.s: (r.n_behaviours, r.n_ids, r.n, r.ok) for r in experiments.corpus_check(corpus, "id", "s", "b", 1, 2, 2).collect()} == {"a": (1, 2, 2, True), "b": (1, 1, 1, False), None: (2, 2, 3, False)}


def test_ledger_grades(spark):
    rows = [(1, 1, "edit", None), (2, 1, "edit", None), (3, 1, "check", 1), (4, 2, "edit", None), (5, 2, "edit", None), (6, 3, "edit", None), (7, 3, "end", None), (8, 2, "check", 2)]
    log = spark.createDataFrame([(*r, r[0], f"t{r[0]}") for r in rows], "decision_id long, session_id long, decision string, parent_id long, checksum long, ts string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "decision_id long")
    linked = decisions.ledger(log, ids(4, 4), ids(5))
    assert {r.decision_id: r.grade for r in linked.collect()} == {1: "strong", 2: "unlinked", 4: "partial", 5: "strong", 6: "partial"}
    assert decisions.coverage(linked, log).first().asDict() == {"decisions": 5, "label_rate": 0.2, "exact_verification_rate": 0.2, "commit_link_rate": 0.2, "sessions": 3, "session_outcome_rate": 0.333333}
    assert decisions.coverage(linked.limit(0), log.limit(0)).first().label_rate is None


def test_override_survival(spark):
    rows = [("allowed_via_override", "a", 1), ("allowed_via_override", "a", 2), ("allowed_via_override", "b", None), ("allowed_via_override", "gone", 1), ("allowed_via_override", None, 1), ("blocked", "a", 1)]
    log = spark.createDataFrame(rows, "decision string, file_path string, digest long")
    current = spark.createDataFrame([("a", 1), ("b", 1)], "file_path string, digest long")
    assert tuple(decisions.override_survival(log, current).first()) == (4, 1, 1, 2, 0.25, 0.25)
    assert tuple(decisions.override_survival(log.limit(0), current).first()) == (0, 0, 0, 0, 0.0, 0.0)
