"""Queries over source text, rules, logs and labels that the tables only stand in for: source is
made by a rule from ids, so that SQL knows what a parser has to find in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import code as C
from ledgerline.operators import decisions as D
from ledgerline.operators import experiments as E
from ledgerline.operators import gates as G
from ledgerline.operators import paths as P
from ledgerline.operators import rules as R
from ledgerline.operators import shell as Sh
from ledgerline.operators import texts as X
from ledgerline.operators import vectors as V
from ledgerline.plans.collect import collection
from ledgerline.plans.event_queries import LOG, decision_log
from ledgerline.plans.screen_queries import K, events, with_k
from ledgerline.plans.text_queries import _chosen, dealt, table
from ledgerline.plans.vector_queries import TEST_RECALL

QUERIES, ORACLES, query = collection()


def source(n, m, imported):
    """n functions with m branches each (9 of either at most), every one a call of the next; and an import."""
    branches = dealt(["".join(f"    if x > {j}:\n        x = f@(x)\n" for j in range(size)) for size in range(10)], m)
    body = lambda i: F.concat(F.lit(f"def f{i}(x):\n"), F.replace(branches, F.lit("@"), ((i + 1) % F.nullif(n, F.lit(0))).cast("string")), F.lit("    return x\n"))
    return F.concat(F.lit("import os\nfrom pkg.m"), imported.cast("string"), F.lit(" import g\n"), *[F.when(n > i, body(i)).otherwise("") for i in range(9)])


def _source(n: str, m: str, imported: str) -> str:
    branch = f"list_transform(range(0, {m}), lambda j: '    if x > ' || j || ':' || chr(10) || '        x = f' || (i + 1) % {n} || '(x)' || chr(10))"
    body = f"list_transform(range(0, {n}), lambda i: 'def f' || i || '(x):' || chr(10) || coalesce(array_to_string({branch}, ''), '') || '    return x' || chr(10))"
    return f"'import os' || chr(10) || 'from pkg.m' || {imported} || ' import g' || chr(10) || coalesce(array_to_string({body}, ''), '')"


SOURCES = f"""sizes AS (SELECT event_id, {K} % 9 AS k, event_id % 6 AS n, {K} % 4 AS m, event_id // 6 % 6 AS n2, {K} // 4 % 4 AS m2 FROM events),
    sources AS (SELECT *, {_source("n", "m", "k")} AS before, {_source("n2", "m2", "k")} AS after FROM sizes)"""


def spread(spark, sf_dir):
    """Events dealt by id as they are read, before anything is made of them: a parse costs far more than its row, and the scan's parts are few."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return with_k(e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id"))


def sources(spark, sf_dir):
    e = spread(spark, sf_dir).select("event_id", (F.col("k") % 9).alias("k"), (F.col("event_id") % 6).alias("n"), (F.col("k") % 4).alias("m"), (F.floor(F.col("event_id") / 6) % 6).alias("n2"), (F.floor(F.col("k") / 4) % 4).alias("m2"))
    return e.withColumns({"before": source(F.col("n"), F.col("m"), F.col("k")), "after": source(F.col("n2"), F.col("m2"), F.col("k"))})


@query("""SELECT event_id, CAST(n * m AS INTEGER) AS branches, CAST(CASE WHEN n = 0 THEN 3 WHEN m = 0 THEN 5 ELSE 7 END AS INTEGER) AS depth, CAST(n > 0 AND m > 0 AS INTEGER) AS max_in, CAST(n > 0 AND m > 0 AS INTEGER) AS max_out,
                 CAST(CASE WHEN m > 0 THEN n ELSE 0 END AS INTEGER) AS edges, CAST(n > 1 AND m = 0 AS INTEGER)::DOUBLE AS alone, 'os,pkg.m' || k AS imports,
                 CASE WHEN m > 0 THEN coalesce(array_to_string(list_transform(range(0, n), lambda i: 'f' || i), ','), '') ELSE '' END AS functions, TRUE AS compiles FROM sources""", SOURCES)  # fmt: skip
def code_metrics(spark, sf_dir):
    s = sources(spark, sf_dir).select("event_id", "before").withColumn("c", C.metrics_arrow_udf("before"))
    told = s.select("event_id", F.inline(F.array("c")))
    return told.withColumns({k: F.array_join(k, ",") for k in ("imports", "functions")})


_COLD = "length(trim(before)) < 32"
_CLAMP = lambda x, scale: f"CASE WHEN {_COLD} THEN 0.0::DOUBLE ELSE round(greatest(0, least(1, ({x}) / {scale}.0::DOUBLE)), 6) END"
_IN = lambda n, m: f"CAST({n} > 0 AND {m} > 0 AS INTEGER)"
_DEPTH = lambda n, m: f"CASE WHEN {n} = 0 THEN 3 WHEN {m} = 0 THEN 5 ELSE 7 END"
_LINES = lambda x: f"list_distinct(string_split({x}, chr(10)))"


@query(f"""SELECT event_id, {_CLAMP("n2 * m2 - n * m", 20)} AS cyclomatic, {_CLAMP(f"{_IN('n2', 'm2')} - {_IN('n', 'm')}", 8)} AS fan_in, {_CLAMP(f"{_IN('n2', 'm2')} - {_IN('n', 'm')}", 12)} AS fan_out,
                 {_CLAMP(f"{_DEPTH('n2', 'm2')} - {_DEPTH('n', 'm')}", 40)} AS depth,
                 {_CLAMP(f"len(list_filter({_LINES('before')}, lambda x: NOT list_contains({_LINES('after')}, x))) + len(list_filter({_LINES('after')}, lambda x: NOT list_contains({_LINES('before')}, x)))", 200)} AS churn,
                 {_CLAMP("CASE WHEN m2 > 0 THEN n2 ELSE 0 END - CASE WHEN m > 0 THEN n ELSE 0 END", 40)} AS coupling,
                 {_CLAMP("CAST(n2 > 1 AND m2 = 0 AS INTEGER) - CAST(n > 1 AND m = 0 AS INTEGER)", 1)} AS cohesion, round(k / 10.0::DOUBLE, 6) AS novelty FROM sources""", SOURCES)  # fmt: skip
def edit_risk(spark, sf_dir):
    s = sources(spark, sf_dir).withColumn("b", C.metrics_arrow_udf("before")).withColumn("a", C.metrics_arrow_udf("after"))
    deltas = C.risk_deltas(F.col("b"), F.col("a"), X.churn(F.col("before"), F.col("after")), F.col("k") / 10)
    risk = G.risk_vector(deltas, F.length(F.trim("before")) < V.COLD_CHARS)
    names = ("cyclomatic", "fan_in", "fan_out", "depth", "churn", "coupling", "cohesion", "novelty")
    return s.withColumn("r", risk).select("event_id", *[F.round(F.col("r")[i], 6).alias(x) for i, x in enumerate(names)])


@query("SELECT event_id, CAST(1 + k % 3 AS INTEGER) AS line FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def edited_lines(spark, sf_dir):
    e = events(spark, sf_dir)
    lines = lambda i, new: F.when(F.col("k") % 3 == i, F.lit(new)).otherwise(F.lit(f"line {i}"))
    after = F.concat_ws("\n", *[lines(i, f"new {i}") for i in range(3)])
    return e.select("event_id", F.explode(C.changed_lines_udf(F.lit("line 0\nline 1\nline 2"), after)).alias("line"))


#: globs of either dialect, and what they say in SQL of a path p; null where it isn't asked
GLOBS = {
    "src/*.py": ("p LIKE 'src/%.py' OR p LIKE '/%/src/%.py'", "path LIKE 'src/%.py'"),
    "**/m1?/*.ts": ("len(s) >= 2 AND ends_with(p, '.ts') AND length(s[-2]) = 3 AND starts_with(s[-2], 'm1')", "len(string_split(path, '/')) >= 2 AND ends_with(path, '.ts') AND regexp_matches(path, '/m1./')"),
    "m*/f[0-3].py": ("regexp_matches(p, '^(/(.*/)?)?m.*/f[0-3][.]py$')", "path LIKE 'm%' AND right(path, 6) IN ('/f0.py', '/f1.py', '/f2.py', '/f3.py')"),
    "docs/**": ("list_contains(s, 'docs')", "starts_with(path, 'docs/')"),
    "*.py": ("ends_with(p, '.py')", "ends_with(path, '.py')"),
    "./src//**/f?.ts": ("list_contains(s[:-2], 'src') AND ends_with(p, '.ts') AND length(s[-1]) = 5", None),
    "/w/a/../src/**": ("starts_with(p, '/w/src/')", None),
    "src/m3/f3.ts": ("p = 'src/m3/f3.ts' OR p LIKE '/%/src/m3/f3.ts'", "path = 'src/m3/f3.ts'"),
}
_HEADS = ("src/", "a/m1", "docs/x/", "", "src/q/r/", "/w/src/", "./a/../src/", "/w//docs/../src/./", "../src/")
_PLAIN = ("src/", "a/m1", "docs/x/", "", "src/q/r/", "/w/src/", "src/", "/w/src/", "../src/")
_TAIL = f"'m' || {K} % 12 || '/f' || event_id % 5 || {_chosen(('.py', '.ts'), K)}"
_FILES = f"files AS (SELECT event_id, path, p, string_split(p, '/') AS s FROM (SELECT event_id, {_chosen(_HEADS, 'event_id')} || {_TAIL} AS path, {_chosen(_PLAIN, 'event_id')} || {_TAIL} AS p FROM events))"


@query(f"""SELECT event_id, {", ".join(f"({p}) AS path_{i}" for i, (p, _) in enumerate(GLOBS.values()))}, {", ".join(f"({s}) AS scope_{i}" for i, (_, s) in enumerate(GLOBS.values()) if s)} FROM files""", _FILES)
def glob_dialects(spark, sf_dir):
    i, k = F.col("event_id"), F.col("k")
    path = F.concat(dealt(_HEADS, i), F.lit("m"), (k % 12).cast("string"), F.lit("/f"), (i % 5).cast("string"), dealt((".py", ".ts"), k))
    files = events(spark, sf_dir).select("event_id", path.alias("path"), P.normalised_path(path).alias("p"))
    told = [P.matches_path(F.col("p"), [g], normal=True).alias(f"path_{n}") for n, g in enumerate(GLOBS)]
    return files.select("event_id", *told, *[F.col("path").rlike(R.scope_glob(g)).alias(f"scope_{n}") for n, (g, (_, s)) in enumerate(GLOBS.items()) if s])


#: a statement is four lines of a dumped tree, the frame three more; what follows a statement is on its last line
_DUMPED = lambda n, ok: f"CASE WHEN NOT {ok} THEN 0 WHEN {n} = 0 THEN 1 ELSE 2 + 4 * {n} END"
_SIDES = f"sides AS (SELECT event_id, event_id % 7 AS n, {K} % 5 AS m, event_id % 11 > 0 AS ok, {K} % 6 > 0 AS ok2 FROM events)"


@query(f"""SELECT event_id, CAST(CASE WHEN ok AND ok2 THEN CASE WHEN n = m THEN 0 WHEN n = 0 OR m = 0 THEN 1 + 2 + 4 * (n + m) ELSE 4 * abs(n - m) + 2 END
                 WHEN NOT ok AND NOT ok2 THEN abs(n - m) ELSE {_DUMPED("n", "ok")} + {_DUMPED("m", "ok2")} END AS INTEGER) AS distance FROM sides""", _SIDES)  # fmt: skip
def tree_distances(spark, sf_dir):
    """Sources of a few assignments, some with a line that doesn't parse."""
    i, k = F.col("event_id"), F.col("k")

    def text(n, ok):
        some = F.slice(F.array(*[F.lit(f"v{x} = {x}\n") for x in range(7)]), F.lit(1), n.cast("int"))
        return F.concat(F.array_join(some, ""), F.when(ok, "").otherwise("a b(\n"))

    both = events(spark, sf_dir).select("event_id", text(i % 7, i % 11 > 0).alias("before"), text(k % 5, k % 6 > 0).alias("after"))
    return both.select("event_id", C.tree_distance_udf("before", "after").alias("distance"))


_STREAM = f"parts AS (SELECT event_id, {K} % 4 AS n, event_id % 3 AS sign FROM events)"


@query("""SELECT event_id, array_to_string(['N:open', 'K:+', ['K:<', 'K:>=', 'K:+'][1 + sign]] || flatten(list_transform(range(0, n), lambda j: ['N:call' || j, 'K:*', 'N:attr'])) || ['N:y', 'N:y'], ' ') AS tokens FROM parts""", _STREAM)
def logic_token_streams(spark, sf_dir):
    """Functions whose callees, operators and free names stand out from local names, numbers, strings, annotations."""
    i, k = F.col("event_id"), F.col("k")
    calls = F.slice(F.array(*[F.lit(f"    self.x += call{j}(1) * fn.attr  # note\n") for j in range(4)]), F.lit(1), (k % 4).cast("int"))
    text = F.concat(
        F.lit("@deco(1 + 2)\ndef name"), k.cast("string"), F.lit("(a: int, fn=None) -> list[str]:\n    b: dict[str, int] = open('<' + f'{a * 3}', 9)\n    if b "), dealt(("<", ">=", "+"), i),
        F.lit(" 2:\n        pass\n"), F.array_join(calls, ""), F.lit("    for q in b:\n        q = [y for y in a]\n    return not q and 5\n\ndef other(): return 1 + 1\n"),
    )
    made = spread(spark, sf_dir).select("event_id", text.alias("text"))
    return made.select("event_id", F.array_join(C.logic_tokens_udf("text"), " ").alias("tokens"))


#: a patch made of parts, with the errors that each brings
_PATCH = f"patch AS (SELECT event_id, event_id % 5 = 0 AS blank, {K} % 3 = 0 AS bare, {K} % 7 = 1 AS less, event_id % 4 = 3 AS worse, event_id % 13 = 0 AS none FROM events)"


@query("""SELECT event_id, CASE WHEN none THEN '0 empty_input' ELSE array_to_string(list_filter([
                 CASE WHEN blank THEN '5 empty_context' END, CASE WHEN bare THEN 5 + CAST(blank AS INTEGER) || ' missing_prefix' END,
                 CASE WHEN blank <> less THEN '3 count_mismatch' END, CASE WHEN worse THEN 7 + CAST(blank AS INTEGER) + CAST(bare AS INTEGER) || ' bad_hunk_header' END], lambda x: x IS NOT NULL), ',') END AS errors,
                 CASE WHEN NOT none AND (blank OR bare OR less OR worse) THEN coalesce(CASE WHEN NOT worse THEN '@@ -1,' || 2 + CAST(blank AS INTEGER) || ' +1,' || 2 + CAST(blank AS INTEGER) || ' @@' END, 'none') END AS repaired FROM patch""", _PATCH)  # fmt: skip
def diff_findings(spark, sf_dir):
    """Patches with bare empty lines, lines without a sign, wrong counts and headers; and the header of the repaired one."""
    i, k = F.col("event_id"), F.col("k")
    blank, bare, less, worse, none = i % 5 == 0, k % 3 == 0, k % 7 == 1, i % 4 == 3, i % 13 == 0
    # a count that is one more than there is without the blank line: right only with it
    count = F.when(less, "3").otherwise("2")
    text = F.concat(
        F.lit("--- a/f\n+++ b/f\n@@ -1,"), count, F.lit(" +1,"), count, F.lit(" @@\n same\n"), F.when(blank, "\n").otherwise(""), F.when(bare, "wrapped\n").otherwise(""),
        F.lit("-old\n+new\n"), F.when(worse, "@@ nowhere\n same\n").otherwise(""),
    )
    made = events(spark, sf_dir).select("event_id", F.when(~none, text).alias("text"))
    told = made.select("event_id", C.diff_findings_udf("text").alias("f"))
    return told.select("event_id", F.col("f.errors").alias("errors"), F.col("f.repaired").alias("repaired"))


#: text, and the directive's name, reason and line in it
HEADS = (("# rc:skip\nx", "skip", "", 1), ("import a\n  // rc:override  trusted change \n", "override", "trusted change", 2), ("a\nb\n<!-- rc:skip-lang because -->", "skip-lang", "because", 3),
         ("\n" * 20 + "# rc:skip", None, None, None), ("x = '# rc:skip'", None, None, None), ("# rc: skip", None, None, None), ("#rc:skip-mock\n# rc:skip", "skip-mock", "", 1), ("# rc:skipper", None, None, None))
SUBJECTS = (('Revert "x"\n\nThis reverts commit abcdef0123.', "r", "abcdef0123"), ("fix: a bug", "f", None), ("  Amend y", "a", None), ("squash! it", "a", None), (":bug: fix(z): w", "f", None), ("prefix only", "", None), ("🐛 hotfix: q", "f", None), ("fixup the bug", "a", None))
COMMANDS = (("python -m pytest -q", "test"), ("ruff check .", "lint"), ("npx tsc --noEmit", "typecheck"), ("make all", None), ("make  check", "build"), ("ls", None), ("cargo clippy", "lint"), ("npm run build && npm test", "test"), ("xpytest", None), ("pnpm run test", "test"))
_told = lambda xs, k, by: "[" + ", ".join("NULL" if x[k] is None else repr(x[k]) for x in xs) + f"][1 + ({by}) % {len(xs)}]"


@query(f"""SELECT event_id, {_told(HEADS, 1, "event_id")} AS directive, {_told(HEADS, 2, "event_id")} AS reason, CAST({_told(HEADS, 3, "event_id")} AS INTEGER) AS line, coalesce({_told(HEADS, 1, "event_id")} IN ('skip', 'override', 'skip-lang'), FALSE) AS no_lang,
                 {_told(SUBJECTS, 1, "event_id")} AS flags, {_told(SUBJECTS, 2, "event_id")} AS reverts, {_told(COMMANDS, 1, K)} AS verification FROM events""")  # fmt: skip
def directives_and_kinds(spark, sf_dir):
    i = F.col("event_id")
    found, flags = R.directive(dealt([x[0] for x in HEADS], i)), X.commit_flags(dealt([x[0] for x in SUBJECTS], i))
    told = F.concat(*[F.when(flags[k], k[0]).otherwise("") for k in ("amend", "revert", "fix")])
    return events(spark, sf_dir).select(
        "event_id", found["name"].alias("directive"), found["reason"].alias("reason"), found["line"].alias("line"), R.bypasses(found, "lang").alias("no_lang"),
        told.alias("flags"), flags["reverts"].alias("reverts"), X.verification_kind(dealt([x[0] for x in COMMANDS], F.col("k"))).alias("verification"),
    )


#: pieces of commands: where to, what, and how it ends; the verdicts follow from the pieces
_GO = ("", "cd conf && ", "cd /tmp; ", "A=1 ")
_DO = ("git status", "git checkout main", "git push -f", "rm settings.json", "cp a.txt conf/settings.json", "cat settings.json", "dd if=x of=conf/settings.json", "echo 'git reset; rm x'", "sed -i s/a/b/ src/x.ts", "pkill -f gatekeeper", "env git log", "ls # rm settings.json")
_END = ("", " 2>&1 | cat", " > 'conf/../out.txt'", " || git commit -qm \"a 'b' c\"")


@query(f"""SELECT event_id, CASE WHEN did = 10 THEN 'hard_deny' WHEN did IN (1, 2) THEN 'git'
                 WHEN did = 3 AND go = 1 OR did = 4 AND go <> 2 OR did = 6 AND go <> 2 THEN 'guarded_write' WHEN did IN (4, 6) THEN 'guarded_write'
                 WHEN did = 9 THEN 'process_kill' WHEN did = 8 THEN 'source_write' ELSE 'allow' END AS verdict
          FROM (SELECT event_id, event_id % {len(_GO)} AS go, {K} % {len(_DO)} AS did FROM events)""")  # fmt: skip
def screened_commands(spark, sf_dir):
    """Commands put together from pieces; a guarded file is hit wherever the command stands."""
    i, k = F.col("event_id"), F.col("k")
    text = F.concat(dealt(_GO, i), dealt(_DO, k), F.when(k % len(_DO) == 11, "").otherwise(dealt(_END, F.floor(i / 4))))
    return Sh.screened(events(spark, sf_dir).select("event_id", text.alias("command")), "command", ["conf/settings.json"], ["gatekeeper"], cwd="/w").select("event_id", "verdict")


@query(f"""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'a' ELSE '' END || CASE WHEN {K} % 4 = 0 THEN 'c' ELSE '' END || 'd' AS changed,
                 '[REDACTED]' AS api_key, 'v' || {K} % 4 AS plain FROM events""")
def manifest_diffs(spark, sf_dir):
    i, k = F.col("event_id"), F.col("k")
    text = lambda c: c.cast("string")
    before = F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("1"), F.lit("d"), F.lit("x"))
    after = F.map_concat(F.create_map(F.lit("a"), text(i % 3), F.lit("b"), F.lit("1")), F.when(k % 4 == 0, F.create_map(F.lit("c"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))
    config = G.redacted_config(F.create_map(F.lit("Api_Key"), text(i), F.lit("plain"), F.concat(F.lit("v"), text(k % 4))))
    return events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.map_keys(G.manifest_changes(before, after))), "").alias("changed"), config["Api_Key"].alias("api_key"), config["plain"].alias("plain"))


@query(f"""SELECT event_id, round(CASE WHEN event_id % 5 > 0 THEN greatest(0, least(1, value / 100 / ((event_id % 5) / 2.0::DOUBLE))) ELSE greatest(0, least(1, value / 100)) END, 6) AS drift,
                 CASE WHEN value / 100 > 0.5 THEN 'x' ELSE '' END || CASE WHEN {K} % 10 > 4 THEN 'y' ELSE '' END AS fired,
                 CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN -1 WHEN {K} % 3 = 0 THEN CASE WHEN {K} % 2 = 0 OR event_id % 2 = 0 THEN -1 ELSE 0 END WHEN {K} % 3 = 1 THEN 1 ELSE 0 END AS step_label FROM events""")  # fmt: skip
def drift_and_fired(spark, sf_dir):
    i, k, v = F.col("event_id"), F.col("k"), F.col("value") / 100
    m = lambda **kw: F.create_map(*[y for p in kw.items() for y in (F.lit(p[0]), p[1].cast("double"))])
    files = F.when(k % 2 == 1, F.array(F.lit("f0"), F.lit("g"))).otherwise(F.array().cast("array<string>"))
    label = G.step_label(F.concat(F.lit("f"), (i % 2).cast("string")), F.when(i % 11 == 0, True), i % 13 == 0, k % 3 == 0, files, k % 3 == 1)
    fired = G.fired(m(x=v, y=k % 10, z=v), m(x=F.lit(0.5), y=F.lit(4)))
    return events(spark, sf_dir).select("event_id", F.round(V.drift(v, (i % 5) / 2), 6).alias("drift"), F.array_join(F.array_sort(F.map_keys(fired)), "").alias("fired"), label.alias("step_label"))


@query("""SELECT a.l_orderkey, a.l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey) AS nth, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem WHERE l_linenumber % 2 = 0) a
          WHERE (l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 1) OR l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber % 2 = 1))
            AND nth > (SELECT count(*) FROM lineitem o WHERE o.l_linenumber % 2 = 1 AND o.l_orderkey = a.l_orderkey AND o.l_partkey = a.l_partkey)""")  # fmt: skip
def duplicate_definitions(spark, sf_dir):
    """Parts of even lines as new definitions, of odd ones as old."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("body"), "l_linenumber")  # noqa: E741
    got = X.duplicate_definitions(l.where("l_linenumber % 2 = 0").select("name", "body"), l.where("l_linenumber % 2 = 1").select("name", "body"))
    return got.withColumnsRenamed({"name": "l_orderkey", "body": "l_partkey"})


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag <> 'R')")
def shared_ids(spark, sf_dir):
    side = lambda f: table(spark, sf_dir, "lineitem").where(f).select(F.col("l_suppkey").alias("id"))
    return X.most_similar(side("l_returnflag = 'R'"), side("l_returnflag <> 'R'"))


@query("""SELECT session_id, decision_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, decision_id DESC) AS rn FROM log) WHERE rn <= 10""", LOG)
def newest_rows(spark, sf_dir):
    """The newest ten of each session: a bounded history is the feature."""
    return D.newest(decision_log(spark, sf_dir), ["session_id"], 10).select("session_id", "decision_id")


_PEERS = """old AS (SELECT a.label, a.vec_id, CAST(a.embedding AS DOUBLE[]) AS v, CAST(b.embedding AS DOUBLE[]) AS p FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id < a.vec_id
         QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id DESC) <= 8),
    centre AS (SELECT vec_id, list(m ORDER BY i) AS c FROM (SELECT vec_id, i, avg(p[i]) AS m FROM old, (SELECT unnest(range(1, 65)) AS i) GROUP BY vec_id, i) GROUP BY vec_id),
    far AS (SELECT vec_id, CAST(count(*) AS INTEGER) AS peer_count, any_value(list_distance(v, c)) AS drift, quantile_cont(list_distance(p, c), 0.5) AS peer_median, 0.05 * quantile_cont(sqrt(list_inner_product(p, p)), 0.5) AS least
            FROM old JOIN centre USING (vec_id) GROUP BY vec_id)"""


@query("""SELECT vec_id, peer_count, round(drift, 6) AS drift, round(peer_median, 6) AS peer_median, round(drift / greatest(peer_median, least), 6) AS ratio, drift / greatest(peer_median, least) > 1.8 AS far FROM far WHERE peer_count >= 3""", _PEERS)
def plan_novelty(spark, sf_dir):
    """Vectors stand in for plans, their kind for the project, their number for the time."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    got = G.plan_novelty(e.withColumn("ts", F.col("vec_id")), "label", "ts", "vec_id", "embedding").where("ratio is not null")
    return got.select("vec_id", "peer_count", *[F.round(c, 6).alias(c) for c in ("drift", "peer_median", "ratio")], "far")


@query("""SELECT stratum, round(1 + (n / CAST(c AS DOUBLE) - 1) * 0.2, 6) AS effect FROM (SELECT o_orderpriority AS stratum, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)""")
def design_effects(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg((F.count(F.lit(1)) / F.countDistinct("o_custkey")).alias("size"))
    return o.select("stratum", F.round(E.design_effect(F.col("size"), F.lit(0.2)), 6).alias("effect"))


@query()
def unresolved_imports(spark, sf_dir):
    """Customers' segments misspelt by their key, against part names (a matcher: tested against the library's own search)."""
    c = table(spark, sf_dir, "customer")
    word = F.lower("c_mktsegment")
    bent = F.concat(F.substring(word, F.lit(1), F.col("c_custkey").cast("int") % 5 + 2), F.lit("x"), F.substring(word, F.col("c_custkey").cast("int") % 4 + 3, F.lit(20)))
    symbols = c.select(word.alias("symbol")).unionByName(table(spark, sf_dir, "part").select(F.lower(F.element_at(F.split("p_type", " "), -1)).alias("symbol"))).distinct()
    got = X.unresolved_imports(c.select(F.col("c_custkey").alias("file"), bent.alias("name")), symbols)
    return got.select("file", "name", F.array_join("suggestions", ",").alias("suggestions"))


@query()
def ranked_duplicates(spark, sf_dir):
    """Vectors with the words of their kind and place as tokens (a matcher: tested against plain loops)."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    own = {5: F.floor(F.col("vec_id") / 40), 60: F.col("label")}  # of 80 tokens these two tell rows apart
    tokens = F.array(*[F.concat(F.lit(f"t{j}_"), own.get(j, F.lit(0)).cast("string")) for j in range(80)])
    f = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), tokens.alias("tokens"), F.col("label").cast("string").alias("path"), F.col("vec_id").alias("line"))
    asked = f.where("id % 20 = 0")
    pairs = V.pairs_above(f.select("id", "vec"), asked.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), TEST_RECALL)
    got = X.ranked_duplicates(pairs, asked.select(F.col("id").alias("qid"), "tokens"), f.select("id", "path", "line", "tokens"))
    return got.withColumn("cosine", F.round("cosine", 6))


_EDITS = f"asked AS (SELECT event_id, event_id % 4 AS kind, ['a', 'zz', 'b'][1 + {K} % 3] AS old, 'a b a ' || {K} AS before, {K} AS k FROM events)"


@query("""SELECT event_id, CASE kind WHEN 0 THEN 'w' || k WHEN 1 THEN CASE WHEN old <> 'zz' THEN regexp_replace(before, old, 'c') END WHEN 2 THEN CASE WHEN old <> 'zz' THEN replace(before, old, 'c') END
                 ELSE CASE WHEN old <> 'zz' THEN 'n' || regexp_replace(regexp_replace(before, old, 'c'), 'c', 'dd') END END AS after FROM asked""", _EDITS)  # fmt: skip
def applied_edits(spark, sf_dir):
    """Whole writes, one replacement, all of them, and several in turn; null where the old text is missing."""
    i, k = F.col("event_id"), F.col("k")
    old = dealt(("a", "zz", "b"), k)
    one = lambda *more: F.concat(F.lit('{"old": "'), old, F.lit('", "new": "c"'), *[F.lit(m) for m in more], F.lit("}"))
    several = F.concat(F.lit('{"edits": ['), one(), F.lit(', {"old": "c", "new": "dd"}, {"old": "", "new": "n"}]}'))
    payload = F.when(i % 4 == 0, F.concat(F.lit('{"content": "w'), k.cast("string"), F.lit('"}'))).when(i % 4 == 1, one()).when(i % 4 == 2, one(', "all": true')).otherwise(several)
    asked = events(spark, sf_dir).select("event_id", dealt(("write", "edit", "edit", "multi"), i).alias("kind"), F.concat(F.lit("a b a "), k.cast("string")).alias("before"), payload.alias("payload"))
    return asked.select("event_id", C.apply_edit_udf("kind", "before", "payload").alias("after"))


@query(f"""SELECT event_id, sha256('{{"a":[1,"x' || event_id % 3 || '",null],"b":{{"c":true,"d":' || {K} || '}}}}') AS digest FROM events""")
def stable_hashes(spark, sf_dir):
    """Digests of values that are written with their keys in another order and with blanks."""
    i, k = F.col("event_id"), F.col("k").cast("string")
    text = F.when(i % 2 == 0, F.concat(F.lit('{"b": {"d": '), k, F.lit(', "c": true}, "a": [1, "x'), (i % 3).cast("string"), F.lit('", null]}'))).otherwise(
        F.concat(F.lit('{ "a":[ 1,"x'), (i % 3).cast("string"), F.lit('",null],\n "b":{"c":true,"d":'), k, F.lit("} }"))
    )
    return events(spark, sf_dir).select("event_id", text.alias("text")).select("event_id", C.stable_hash_udf("text").alias("digest"))


@query(f"""SELECT event_id, CAST(7 * ({K} % 3) AS INTEGER) AS first, CAST(7 * ({K} % 3) + 6 + event_id % 3 AS INTEGER) AS last FROM events""")
def changed_ranges(spark, sf_dir):
    """Byte ranges of one line that has another text, with letters of two bytes."""
    i, k = F.col("event_id"), F.col("k")
    line = lambda j: F.when(k % 3 == j, F.concat(F.lit("né "), F.lpad(F.lit(""), (i % 3).cast("int"), "x"), F.lit("1\n"))).otherwise(F.lit(f"line {j}\n"))
    made = events(spark, sf_dir).select("event_id", F.lit("line 0\nline 1\nline 2\n").alias("before"), F.concat(*[line(j) for j in range(3)]).alias("after"))
    told = made.select("event_id", C.changed_bytes_udf("before", "after").alias("r"))
    return told.select("event_id", F.inline(F.transform("r", lambda r: F.struct(r[0].alias("first"), r[1].alias("last")))))


_FLAGS = ", ".join(f"CAST(event_id % 5 = {j} OR {K} % 7 = {j} AS INTEGER)" for j in range(5))
_RAW = "list_transform(range(1, 6), lambda j: CASE WHEN f[j] = 1 THEN 1.0 WHEN coalesce(f[j - 1], 0) = 1 AND j > 1 OR coalesce(f[j + 1], 0) = 1 THEN 0.25 ELSE 0.0 END)"


@query(f"""SELECT event_id, {", ".join(f"round(CAST(raw[{j + 1}] AS DOUBLE) / list_sum(raw), 6) AS w{j}" for j in range(5))} FROM (SELECT event_id, {_RAW} AS raw FROM (SELECT event_id, [{_FLAGS}] AS f FROM events))""")
def neighbour_weights(spark, sf_dir):
    """Weights of five chunks, of which one or two have changed."""
    i, k = F.col("event_id"), F.col("k")
    made = events(spark, sf_dir).select("event_id", F.array(*[(i % 5 == j) | (k % 7 == j) for j in range(5)]).alias("changed"))
    told = made.select("event_id", C.chunk_weights_udf("changed").alias("w"))
    return told.select("event_id", *[F.round(F.col("w")[j], 6).alias(f"w{j}") for j in range(5)])


@query(f"""SELECT event_id, CAST(ceil(n / 64.0) AS BIGINT) + CAST(m > 0 AS BIGINT) AS chunks, CAST(m > 0 AS BIGINT) AS scopes, CAST(6 * n + CASE WHEN m > 0 THEN 9 + 10 * m ELSE 0 END AS BIGINT) AS bytes
          FROM (SELECT event_id, {K} * 2 AS n, event_id % 3 AS m FROM events) WHERE n + m > 0""")  # fmt: skip
def source_chunks(spark, sf_dir):
    """Plain lines in windows, and a function on its own; chunks cover the text."""
    i, k = F.col("event_id"), F.col("k")
    body = F.when(i % 3 > 0, F.concat(F.lit("def f():\n"), F.expr("repeat('    x = 1\n', CAST(event_id % 3 AS INT))"))).otherwise("")
    made = spread(spark, sf_dir).select("event_id", F.concat(F.expr("repeat('y = 2\n', CAST(k * 2 AS INT))"), body).alias("source"))
    # an inner inline would have Spark cut the texts before the deal too, for a filter on the cuts
    cut = made.select("event_id", C.chunks_udf("source").alias("c")).select("event_id", F.inline_outer("c"))
    told = cut.groupBy("event_id").agg(F.count("kind").alias("chunks"), F.count(F.when(F.col("kind") == "scope", 1)).alias("scopes"), F.sum(F.col("end") - F.col("first")).alias("bytes"))
    return told.where("chunks > 0")
