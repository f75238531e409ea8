"""Screens on small fixtures."""

from pyspark.sql import functions as F

from ledgerline.operators import screens


def test_line_ends_are_those_of_splitlines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h ", "a b\tc", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(screens.text_lines(F.col("t"))).collect()]
    assert got == [(t or "").splitlines() for t in texts]


def test_patches_and_hunks(spark):
    py = "diff --git a/x.py b/x.py\n+1\n"
    rows = [
        ("r", py, "<15 min fix"), ("r", py * 5, "15 min - 1 hour"), ("r", py * 6, "<15 min fix"), ("r", py, "1-4 hours"), ("big/repo", py, "<15 min fix"), ("r", py + "see a.C\n", "<15 min fix"),
        ("r", "diff --git a/x.py b/x.go", "<15 min fix"), ("r", "diff --git x.py", "<15 min fix"), ("r", "", "<15"), (None, None, None), (None, py, "<15 min"),
    ]
    df = spark.createDataFrame(rows, "r string, p string, d string")
    got = [r[0] for r in df.select(screens.eligible_patch(F.col("r"), F.col("p"), F.col("d"), ["big/repo"])).collect()]
    assert got == [True, True, False, False, False, False, False, False, False, False, True]
    hunk = "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n keep\n-old\n+new\nbare\n"
    before, after = screens.hunk_sides(F.col("h"))
    assert tuple(spark.createDataFrame([(hunk,)], "h string").select(before, after).first()) == ("keep\nold\nbare", "keep\nnew\nbare")
    assert tuple(spark.createDataFrame([(None,)], "h string").select(before, after).first()) == ("", "")


def test_prompts(spark):
    rows = [
        ("Implement x and Implement y, editing nothing", None, ["implement"], "advisory"), ("please edit a/guard.py", None, ["edit"], "blocked"), ("look at a/guard.py", None, [], "allowed"),
        ("run pytest", "csharp", [], "blocked"), ("run pytest [rc:allow-foreign-lang]", "csharp", [], "allowed"), ("run pytest", "python", [], "allowed"), (None, "csharp", [], "allowed"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, d string")
    got = screens.screen_prompt(F.col("p"), ["a/guard.py"], F.col("d"))
    out = df.select(got["verbs"].alias("v"), got["decision"].alias("d")).collect()
    assert [(r.v, r.d) for r in out] == [r[2:] for r in rows]
    soft = screens.screen_prompt(F.col("p"), ["a/guard.py"], F.col("d"), override=True, shadow=True)
    assert [r[0] for r in df.select(soft["decision"]).collect()][1:4] == ["advisory", "allowed", "shadow_blocked"]


def test_plan_paths(spark):
    plan = "- src/foo.py — ~120 LOC\n* `tests/bar.spec.ts`: ~250 lines\n+ big.go 1500 loc\nsee `x/y.rs`, Model/A.cs:11, src/Dockerfile, MyDockerfile, .env.example and src/.gitignore\n# Phase 1\n## step 2\nin one file"
    df = spark.createDataFrame([(plan,), ("",), (None,)], "p string")
    got = [r[0] for r in df.select(screens.plan_paths(F.col("p"))).collect()]
    assert got[0] == sorted([".env.example", "Model/A.cs", "big.go", "src/.gitignore", "src/Dockerfile", "src/foo.py", "tests/bar.spec.ts", "x/y.rs"]) and got[1] == got[2] == []
    found = df.select(*[c.alias(k) for k, c in screens.plan_findings(F.col("p")).items()]).collect()
    assert tuple(found[0]) == (8, 2, 1, 1, False, True) and tuple(found[1]) == (0, 0, 0, 0, False, False)


def test_agreement_and_clusters(spark):
    rows = [("pos", 1, 1, None, 1), ("pos", 1, 0, None, 1), ("neg", None, None, None, 0), ("neg", 1, 1, 0, 0)]
    df = spark.createDataFrame(rows, "c string, a int, b int, d int, label int")
    majority = F.when(F.col("a") == F.col("b"), F.col("a"))
    got = {r.c: (r.n, r.unreachable, r.no_majority, r.total, r.agree, r.disagree, r.rate) for r in screens.agreement(df, "c", ["a", "b", "d"], "label", majority).collect()}
    assert got == {"pos": (2, 0, 1, 1, 1, 0, 1.0), "neg": (2, 1, 0, 1, 0, 1, 0.0), None: (4, 1, 1, 2, 1, 1, 0.5)}
    runs = [("x", "control", True), ("x", "treatment", False), ("y", "control", True), ("z", "control", False), ("z", "treatment", True)]
    df = spark.createDataFrame(runs, "b string, arm string, e boolean")
    assert sorted(map(tuple, screens.behaviour_clusters(df, "b", "arm", "e").collect())) == [("x", 1, 1, 0), ("z", 1, 0, 1)]
    more = df.unionByName(spark.createDataFrame([(None, "control", True)], df.schema))
    assert screens.behaviour_clusters(more, "b", "arm", "e").count() == 0


def test_samples(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    asked = screens.prompted(df, "k", "s").count()
    assert 140 < asked < 260 and asked == screens.prompted(df, "k", "s").count() and screens.picked(df, "k", "s").count() == 1
    assert screens.picked(df.limit(0), "k", "s").count() == 0


def test_closest_symbols_are_the_librarys(spark, monkeypatch):
    import difflib
    import random

    from ledgerline.operators import texts

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcde_", k=rng.randint(1, 9)))
    symbols, names = sorted({word() for _ in range(150)}), [word() for _ in range(60)] + ["", "zzzz"]
    got = {}
    rows = texts.closest_symbols(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in symbols], "symbol string"), block=40).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.name, []).append(r.symbol)
    assert got == {x: m for x in set(names) if x and (m := difflib.get_close_matches(x, symbols, 3, 0.6))}
    imports = spark.createDataFrame([("f", symbols[0]), ("f", "zzzz"), ("g", symbols[0] + "q"), ("g", symbols[0] + "q")], "file string, name string")
    out = {(r.file, r.name): r.suggestions for r in texts.unresolved_imports(imports, spark.createDataFrame([(x,) for x in symbols], "symbol string")).collect()}
    assert out == {("f", "zzzz"): [], ("g", symbols[0] + "q"): difflib.get_close_matches(symbols[0] + "q", symbols, 3, 0.6)}


def test_ranked_duplicates_by_plain_loops(spark):
    import difflib
    import random

    from ledgerline.operators import texts

    rng = random.Random(5)
    base = [[f"w{rng.randrange(30)}" for _ in range(40)] for _ in range(4)]
    tokens = {i: [t if rng.random() > 0.02 else f"u{rng.randrange(6)}" for t in base[i % 4]] for i in range(60)}
    pairs = [(q, i, rng.choice([0.85, 0.9, 0.99])) for q in range(0, 60, 7) for i in range(60) if i != q and rng.random() < 0.7]
    functions = spark.createDataFrame([(i, f"p{i % 3}", i, t) for i, t in tokens.items()], "id long, path string, line long, tokens array<string>")
    got = texts.ranked_duplicates(spark.createDataFrame(pairs, "qid long, id long, cosine double"), functions.selectExpr("id as qid", "tokens"), functions).collect()
    df = {}
    for t in tokens.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    cutoff, want = max(3, int(0.03 * 60)), []
    for q in sorted({p[0] for p in pairs}):
        hits = []
        for _, i, cos in (p for p in pairs if p[0] == q):
            ratio = difflib.SequenceMatcher(None, tokens[q], tokens[i]).ratio()
            if ratio >= 0.97:
                hits.append((-len([x for x in set(tokens[q]) & set(tokens[i]) if df[x] <= cutoff]), -ratio, -cos, f"p{i % 3}", i))
        want += [(q, h[4], -h[0], rank) for rank, h in enumerate(sorted(hits), 1)]
    assert sorted((r.qid, r.id, r.n_shared, r["rank"]) for r in got) == sorted(want) and len(want) > 20


def test_plain_pairs_of_ranked_duplicates_need_no_matcher(spark, monkeypatch):
    """Sequences without repeats that differ place by place are told apart in columns, once a pair, and the others by one call of the matcher."""
    import difflib

    from ledgerline.functions import code
    from ledgerline.operators import texts

    base = [f"w{i}" for i in range(80)]
    put = lambda *at: [f"u{i}" if i in at else x for i, x in enumerate(base)]
    tokens = {0: base, 1: put(3, 70), 2: base[1:] + base[:1], 3: put(3), 4: base[:-1], 5: [*base[1::-1], *base[2:]], 6: put(1, 2, 3, 4), 7: ["w0", *base[:-1]], 8: []}
    functions = spark.createDataFrame([(i, "p", i, t) for i, t in tokens.items()], "id long, path string, line long, tokens array<string>")
    pairs = spark.createDataFrame([(q, i, 0.9) for q in tokens for i in tokens if q != i], "qid long, id long, cosine double")
    want = {(q, i): r for q in tokens for i in tokens if q != i and (r := difflib.SequenceMatcher(None, tokens[q], tokens[i]).ratio()) >= 0.97}
    asked = functions.selectExpr("id as qid", "tokens")
    got = texts.ranked_duplicates(pairs, asked, functions)
    assert {(r.qid, r.id): r.logic_ratio for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1 and plan.count("ArrowEvalPython") == 1
    monkeypatch.setattr(code, "sequence_ratio_udf", lambda a, b: F.when(F.size(a) > 0, F.raise_error(F.lit("matched"))).otherwise(1.0))
    plain = pairs.where("qid in (0, 1, 3, 6) and id in (0, 1, 3, 6)")
    assert texts.ranked_duplicates(plain, asked, functions).count() == len([k for k in want if set(k) <= {0, 1, 3, 6}])
