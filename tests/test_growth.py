"""What keeps work in step with the input."""

import pytest

from ledgerline.functions import code as C
from ledgerline.plans import code_queries as Q


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.range(600).selectExpr("id AS event_id", """concat('{"k": ', id % 100, '}') AS props""").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_equal_texts_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(C, "parse", lambda text, was=C.parse: parsed.append(text) or was(text))
    text = "def once_only(x):\n    return len(x) + 1\n"
    assert [C.once(C.logic_tokens, t) for t in (text, text, None, text)] == [["N:len", "K:+"], ["N:len", "K:+"], [], ["N:len", "K:+"]]
    assert parsed.count(text) == 1
    long = text + "#" * C.KEPT_CHARS
    assert C.once(C.logic_tokens, long) == C.once(C.logic_tokens, long) and parsed.count(long) == 2  # isn't kept


def test_streams_are_dealt_before_they_are_parsed(spark, events_dir):
    got = Q.logic_token_streams(spark, events_dir)
    assert "REPARTITION_BY_NUM" in plan_of(got)
    assert got.count() == 600


def test_chunks_are_cut_in_batches(spark, events_dir, monkeypatch):
    plan = plan_of(Q.source_chunks(spark, events_dir))
    assert "PythonUDTF" not in plan and "ArrowEvalPython" in plan
    parsed = []
    monkeypatch.setattr(C, "parse", lambda text, was=C.parse: parsed.append(text) or was(text))
    text = "y = 3\n" * 70 + "def f():\n    return 1\n"
    assert [C.once(C.chunks, t) for t in (text, text)] == [[(0, 384, "lines"), (384, 420, "lines"), (420, 442, "scope")]] * 2 and parsed.count(text) == 1


@pytest.mark.parametrize("name", ["edit_risk", "code_metrics"])
def test_rows_are_dealt_before_texts_are_made(spark, events_dir, name):
    plan = plan_of(Q.QUERIES[name](spark, events_dir))
    assert plan.index("def f0(x)") < plan.index("REPARTITION_BY_NUM") and "def f0(x)" not in plan[plan.index("REPARTITION_BY_NUM") :]  # what is printed first comes last


def test_metrics_of_equal_texts_are_taken_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(C, "parse", lambda text, was=C.parse: parsed.append(text) or was(text))
    text = "def taken_once(x):\n    return [y for y in taken_once(x)]\n"
    import pandas as pd

    got = C.metrics_udf.func(pd.Series([text, text, None, text]))
    assert list(got["branches"]) == [1, 1, 0, 1] and list(got["edges"]) == [1, 1, 0, 1] and parsed.count(text) == 1


def test_rows_take_the_metrics_of_their_batchs_different_texts(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(C, "once", lambda f, text, was=C.once: asked.append(text) or was(f, text))
    texts = ["def f(x):\n    return g(x) if x else [y for y in x]\n", None, "", "import b, a\n", "def broken(:\nimport q\n", "x = 'ä'\ndef ü():\n    pass  # and forty characters of a comment\n"] * 50
    import pyarrow as pa

    got = C.metrics_arrow_udf.func(pa.array(texts)).to_pylist()
    assert got == [C.metrics(t) for t in texts] and len(asked) == 6
    assert C.metrics_arrow_udf.func(pa.array([], pa.string())).to_pylist() == [] and C.metrics_arrow_udf.func(pa.array([None, None], pa.large_string())).to_pylist() == [C.metrics(None)] * 2
    monkeypatch.undo()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"a": C.metrics_arrow_udf("text"), "p": C.metrics_udf("text")}).orderBy("id").collect()
    assert [r.a.asDict() for r in rows] == [r.p.asDict() for r in rows] == [C.metrics(t) for t in texts]


@pytest.mark.parametrize("name", ["edit_risk", "code_metrics", "logic_token_streams", "source_chunks"])
def test_rows_are_dealt_as_they_are_read(spark, events_dir, name):
    plan = plan_of(Q.QUERIES[name](spark, events_dir))
    assert "get_json_object" in plan and "get_json_object" not in plan[plan.index("REPARTITION_BY_NUM") :]  # what is printed first comes last


def test_merged_branches_hang_off_one_chain(spark):
    """The main line stays one chain where branches of it are older than its next commit."""
    from ledgerline.operators import commits as O

    rows = [("p", f"m{k:02}", [f"m{k - 1:02}", f"b{k - 1:02}"] if k else [], 10 * k) for k in range(8)] + [("p", f"b{k:02}", [f"m{k:02}"], 10 * k + 5) for k in range(8)]
    nodes, _ = O.label_commits(spark.createDataFrame(rows, "project string, sha string, parents array<string>, ts long"))
    assert {r.chain for r in nodes.where("sha like 'm%'").collect()} == {"m00"}


def line_of_commits(spark, n):
    return spark.createDataFrame([("p", f"{k:04}", [f"{k - 1:04}"] if k else [], k) for k in range(n)], "project string, sha string, parents array<string>, ts long")


def test_links_of_one_time_are_followed_at_once(spark, monkeypatch):
    """A straight history takes no rounds of tables."""
    from ledgerline.operators import commits as O
    from ledgerline.plans import scratch

    tables = []
    monkeypatch.setattr(scratch, "written", lambda df, was=scratch.written: tables.append(df.columns) or was(df))
    nodes, _ = O.label_commits(line_of_commits(spark, 300))
    assert len(tables) <= 7 and [(r.chain, r.place) for r in nodes.orderBy("sha").collect()] == [("0000", k) for k in range(300)]


def test_links_to_other_times_are_followed(spark, monkeypatch):
    from ledgerline.operators import commits as O

    monkeypatch.setattr(O, "SPAN", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes, _ = O.label_commits(line_of_commits(spark, 100))
        assert [(r.chain, r.place, r.date) for r in nodes.orderBy("sha").collect()] == [("0000", k, k) for k in range(100)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    import pyarrow as pa

    monkeypatch.setattr(O, "CHUNK", 3)
    batch = lambda *x: pa.RecordBatch.from_pylist([{"project": p, "sha": s, "ts": 0, "far": f} for p, s, f in x], pa.schema({"project": pa.string(), "sha": pa.string(), "ts": pa.int64(), "far": pa.string()}))
    got = [tuple(r.values()) for b in O._near([batch(("p", "c", "b"), ("p", "a", None), ("p", "b", "a"), ("q", "b", "a")), batch(("p", "d", "c"), ("p", "e", "d"))]) for r in b.to_pylist()]
    assert got == [("p", "c", 0, "a", 2, True), ("p", "a", 0, "a", 0, True), ("p", "b", 0, "a", 1, True), ("q", "b", 0, "a", 1, False), ("p", "d", 0, "c", 1, False), ("p", "e", 0, "c", 2, False)]


def test_a_newer_head_is_walked_once(spark, monkeypatch):
    from ledgerline.operators import commits as O
    from ledgerline.plans import scratch

    nodes, edges = O.label_commits(line_of_commits(spark, 50))
    sizes = []

    def written(df, was=scratch.written):
        out = was(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(scratch, "written", written)
    ranges = O.head_ranges(nodes, edges, spark.createDataFrame([("p", f"{k:04}", "0049") for k in range(40)], "project string, before string, after string"))
    assert sorted((r.lowest, r.highest) for r in ranges.collect()) == [(k, 49) for k in range(40)]
    assert sizes[0] == 40 and sizes[1] == 1  # the pairs, the way down


def test_tasks_grow_in_number_with_touches(spark, monkeypatch):
    from ledgerline.operators import history as H

    monkeypatch.setattr(H, "TOUCHES", 10)
    touches = spark.range(95).selectExpr("id AS sha", "id % 3 AS file", "timestamp_seconds(id * 86400 * if(id % 3 = 0, 1, 0) + id) AS ts")
    got = H.followed_up(touches)
    assert "hashpartitioning(file" in plan_of(got) and ", 10), REPARTITION_BY_NUM" in plan_of(got)
    assert {r.sha for r in got.collect()} == {k for k in range(95) if k % 3 and k + 3 < 95}


def test_degrees_take_edges_and_nodes_in_one_grouping(spark):
    from ledgerline.operators import graph

    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 1)], "src long, dst long")
    got = graph.degrees(edges, spark.createDataFrame([(1,), (1,), (7,), (8,)], "node long"))
    assert plan_of(got).count("Exchange hashpartitioning(src") == 1 and "Join" not in plan_of(got)
    assert got.first().asDict() == {"n_edges": 3, "max_in": 1, "max_out": 2, "n_nodes": 6, "isolated_share": 2 / 6}
    assert graph.degrees(edges).first().asDict() == {"n_edges": 3, "max_in": 1, "max_out": 2, "n_nodes": 4, "isolated_share": 0.0}
    assert graph.degrees(edges.limit(0)).first().asDict() == {"n_edges": 0, "max_in": 0, "max_out": 0, "n_nodes": 0, "isolated_share": 0.0}


def test_plans_are_cut_once(spark):
    from ledgerline.operators import texts as X

    rows = [(1, None), (2, " "), (3, "Change src/a.py:12. Then test it. A race condition may block us."), (4, "- see /api/x\n- as needed")]
    plans = spark.createDataFrame(rows, "id long, text string")
    got = X.with_plan_quality(plans, "text", ["id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "RepartitionByExpression" in plan
    want = plans.select("id", *[c.alias(k) for k, c in X.plan_quality(plans["text"]).items()])
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_cube_is_of_counted_suppliers(spark, tmp_path):
    from ledgerline.plans import screen_queries as S

    spark.range(4000).selectExpr("element_at(array('A', 'N', NULL), cast(id % 3 + 1 as int)) AS l_returnflag", "element_at(array('O', 'F'), cast(id % 2 + 1 as int)) AS l_linestatus", "if(id % 10 = 0, NULL, id % 20) AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = S.grouping_sets(spark, str(tmp_path))
    plan = plan_of(got)
    assert plan.index("Expand") < plan.rindex("partial_count(1)")  # what is printed first comes last
    assert {(r.n, r.n_suppliers) for r in got.where("level = 3").collect()} == {(4000, 18)} and got.count() == 12
    spark.createDataFrame([], "l_returnflag string, l_linestatus string, l_suppkey long").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert S.grouping_sets(spark, str(tmp_path)).count() == 0


def test_changed_edges_come_from_one_grouping(spark):
    from ledgerline.operators import graph

    rows = lambda *x: spark.createDataFrame(x, "a long, b long")
    added, removed = graph.new_edges(rows((1, 1), (1, 1), (2, None), (3, 3)), rows((1, 1), (4, 4), (4, 4), (2, None), (None, None)))
    assert plan_of(added).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in added.collect()} == {(4, 4), (None, None)} and added.count() == 2
    assert [tuple(r) for r in removed.collect()] == [(3, 3)]


def test_equal_commands_are_screened_once(spark, events_dir):
    from ledgerline.operators import shell

    got = Q.screened_commands(spark, events_dir)
    assert "RLIKE" not in plan_of(got) and got.count() == 600
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "git push -f"), (4, "git push -f"), (5, "ls")], "id long, command string")
    assert {r.id: r.verdict for r in shell.screened(rows, "command", []).collect()} == {1: "allow", 2: "allow", 3: "git", 4: "git", 5: "allow"}


def test_quantiles_count_their_values_once(spark):
    from ledgerline.operators import experiments as E

    rows = spark.createDataFrame([(None if k % 3 == 2 else k % 3, float(k % 7)) for k in range(60)] + [(5, None)], "g int, x double")
    got = E.exact_quantiles(rows, ["g"], "x", {"m": 0.5, "p": 0.9})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 2 and "LogicalRDD" not in plan  # the counts, for the running sums and for the pieces
    import numpy as np

    want = {g: [float(k % 7) for k in range(60) if (None if k % 3 == 2 else k % 3) == g] for g in (0, 1, None)}
    assert {r.g: (r.n, r.m, r.p) for r in got.collect()} == {g: (len(x), np.quantile(x, 0.5), np.quantile(x, 0.9)) for g, x in want.items()}
