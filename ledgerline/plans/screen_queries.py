"""Queries of screens, samples and native operators; events, orders and conversations stand in."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.operators import experiments as E
from ledgerline.operators import screens as S
from ledgerline.plans.collect import collection
from ledgerline.plans.text_queries import _chosen, dealt, table

QUERIES, ORACLES, query = collection()
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def with_k(e):
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def events(spark, sf_dir):
    return with_k(table(spark, sf_dir, "events"))


PROJECTS = ("/home/a/repo", "/fake/repo", "/tmp/pytest-of-x/p", "/srv/rc-doctor-canary-1/x", "/srv/my-rc-doctor-canary-1", "/fakes/repo", "")
SESSIONS = ("s1", "rc-doctor-canary-9", "x-rc-doctor-canary-")


@query(f"""SELECT event_id FROM (SELECT event_id, {_chosen(PROJECTS, "event_id")} AS p, {_chosen(SESSIONS, K)} AS s FROM events)
          WHERE NOT (starts_with(p, '/fake/') OR contains(p, '/pytest-') OR starts_with(s, 'rc-doctor-canary-') OR len(list_filter(string_split(p, '/'), lambda x: starts_with(x, 'rc-doctor-canary-'))) > 0)""")
def real_evidence(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where(~S.is_synthetic(dealt(PROJECTS, F.col("event_id")), dealt(SESSIONS, F.col("k")))).select("event_id")


ENDINGS = (".py b/src/m.py", ".py b/tests/test_m.py", ".py b/x/test/m.py", ".py b/a.py", ".py", ".go b/src/m.go")
LEVELS = ("<15 min fix", "15 min - 1 hour", "1-4 hours")
PATCH = f"""patches AS (SELECT event_id, array_to_string(list_transform(range(0, 1 + event_id % 7), lambda i: 'diff --git a/src/m' || i || {_chosen(ENDINGS, f"i * event_id + {K}")} || chr(10) || '+x'), chr(10))
              || CASE WHEN event_id % 13 = 0 THEN ' a.C' || chr(10) ELSE '' END AS patch, {_chosen(LEVELS, K)} AS difficulty, 'r' || {K} % 4 AS repo FROM events)"""


@query("""SELECT event_id, CAST(len(t) AS INTEGER) AS n_tests, repo <> 'r3' AND len(h) BETWEEN 1 AND 5 AND len(list_filter(h, lambda x: NOT regexp_matches(x, '^diff --git\\s+\\S+.*\\s\\S*\\.py$'))) = 0
                 AND NOT contains(lower(patch), '.c' || chr(10)) AND NOT contains(lower(patch), '.go' || chr(10)) AND NOT contains(lower(patch), '.rs' || chr(10))
                 AND (contains(difficulty, '<15') OR contains(difficulty, '15 min')) AS eligible
          FROM (SELECT *, list_filter(h, lambda x: contains(x, '/test') OR contains(x, 'tests/')) AS t FROM (SELECT *, list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, 'diff --git')) AS h FROM patches))""", PATCH)  # fmt: skip
def eligible_patches(spark, sf_dir):
    e, i = events(spark, sf_dir), F.col("event_id")
    files = F.transform(F.sequence(F.lit(0).cast("long"), i % 7), lambda n: F.concat(F.lit("diff --git a/src/m"), n.cast("string"), dealt(ENDINGS, n * i + F.col("k")), F.lit("\n+x")))
    e = e.withColumn("patch", F.concat(F.array_join(files, "\n"), F.when(i % 13 == 0, " a.C\n").otherwise("")))
    ok = S.eligible_patch(F.concat(F.lit("r"), (F.col("k") % 4).cast("string")), F.col("patch"), dealt(LEVELS, F.col("k")), ["r3"])
    return e.select("event_id", S.test_files(F.col("patch")).alias("n_tests"), ok.alias("eligible"))


@query("""SELECT doc_id, text <> '' AND lang <> '' AS has_source_pair, doc_id % 3 = 0 AS has_token_stream, doc_id % 5 = 0 AS has_diff_hunk,
                 coalesce(text <> '' AND lang <> '', FALSE) OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS is_replayable
          FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS text, coalesce(lang, '') AS lang FROM documents)""")
def replayability(spark, sf_dir):
    i = F.col("doc_id")
    has = S.replayable(F.when(i % 2 == 0, F.col("text")), F.col("lang"), F.when(i % 3 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")), F.when(i % 5 == 0, "+x").when(i % 5 == 1, ""))
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in has.items()])


MARKS = ("+", "-", " ", "@@ -1 +1 @@", "", "+++ b/x", "--- a/x", "+")
_MARKED = f"list_transform(string_split(text, chr(10)), lambda x, i: {_chosen(MARKS, 'i - 1 + doc_id')} || x)"


@query("""SELECT doc_id, md5(array_to_string(list_transform(list_filter(l, lambda x: NOT starts_with(x, '+')), lambda x: CASE WHEN regexp_matches(x, '^[- ]') THEN substr(x, 2) ELSE x END), chr(10))) AS before,
                 md5(array_to_string(list_transform(list_filter(l, lambda x: NOT starts_with(x, '-')), lambda x: CASE WHEN regexp_matches(x, '^[+ ]') THEN substr(x, 2) ELSE x END), chr(10))) AS after
          FROM (SELECT doc_id, list_filter(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: NOT regexp_matches(x, '^([+]{3}|-{3}|@@)')) AS l FROM marked)""",
       f"marked AS (SELECT doc_id, {_MARKED} AS l FROM documents WHERE text IS NOT NULL)")
def hunk_sides(spark, sf_dir):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(dealt(MARKS, i + F.col("doc_id")), x)), "\n")
    before, after = S.hunk_sides(F.col("hunk"))
    md5 = lambda x: F.md5(x.cast("binary"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", marked.alias("hunk")).select("doc_id", md5(before).alias("before"), md5(after).alias("after"))


_BIT = lambda n: f"(event_id // {2 ** n}) % 2 = 1"


@query(f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'host_execution_failed' WHEN event_id % 7 = 0 THEN 'tool_unavailable' WHEN NOT a AND NOT h THEN 'tool_not_attempted' WHEN NOT h THEN 'hook_not_invoked'
                 WHEN NOT t THEN 'hook_payload_mismatch' WHEN p THEN CASE WHEN d AND NOT x AND NOT c THEN 'pass' WHEN d THEN 'deny_ignored' WHEN x OR c THEN 'gate_failed_to_deny' WHEN e THEN 'tool_result_error' ELSE 'no_effect' END
                 ELSE CASE WHEN NOT d AND c AND NOT x THEN 'pass' WHEN d THEN 'gate_false_block' WHEN e THEN 'tool_result_error' ELSE 'no_effect' END END AS outcome
          FROM (SELECT event_id, {", ".join(f"{_BIT(n)} AS {c}" for n, c in enumerate("ahtpdxce"))} FROM events)""")
def host_qualification(spark, sf_dir):
    i = F.col("event_id")
    a, h, t, p, d, x, c, e = (F.floor(i / 2**n) % 2 == 1 for n in range(8))
    return events(spark, sf_dir).select("event_id", S.qualification(i % 11 == 0, i % 7 != 0, a, h, t, p, d, x, c, e).alias("outcome"))


GUARDED = ("conf/settings.json", "hooks/guard.py", "core/engine.py")
ASKS = (" Please implement it, then edit hooks/guard.py and Edit conf/settings.json", " just look at core/engine.py", " writing a patch", " pip install x", " pip install x [rc:allow-foreign-lang] refactoring", " credit the editor")
PROMPTS = f"prompts AS (SELECT doc_id, coalesce(text, '') || {_chosen(ASKS, 'doc_id')} AS text, CASE WHEN doc_id % 4 = 0 THEN 'csharp' END AS declared FROM documents)"


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(v)), ',') AS verbs, array_to_string(g, ',') AS guarded,
                   CASE WHEN pv THEN 'blocked' WHEN len(v) = 0 THEN 'allowed' WHEN len(g) > 0 THEN 'blocked' ELSE 'advisory' END AS decision,
                   CASE WHEN pv THEN 'language_pivot_in_subagent:csharp->foreign' WHEN len(v) = 0 THEN 'no_mutation_verb' WHEN len(g) > 0 THEN 'mutation_verb_on_guarded_path' ELSE 'mutation_verb_outside_guarded_paths' END AS reason
            FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{S.MUTATION}'), lambda x: lower(x)) AS v, list_filter({list(GUARDED)}, lambda x: contains(text, x)) AS g,
                         coalesce(declared = 'csharp', FALSE) AND regexp_matches(text, '{S.FOREIGN["csharp"]}') AND NOT contains(text, '[rc:allow-foreign-lang]') AS pv FROM prompts)""", PROMPTS)  # fmt: skip
def screened_prompts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), dealt(ASKS, F.col("doc_id"))).alias("text"), F.when(F.col("doc_id") % 4 == 0, "csharp").alias("declared"))
    got = S.screen_prompt(F.col("text"), GUARDED, F.col("declared"))
    return docs.select("doc_id", F.array_join(F.array_sort(got["verbs"]), ",").alias("verbs"), F.array_join(got["guarded_paths"], ",").alias("guarded"), got["decision"].alias("decision"), got["reason"].alias("reason"))


@query("""SELECT user_id AS path, count(CASE WHEN action = 'exit_block' THEN 1 END) > 0 AS regression,
                 coalesce(arg_min(reason, place) FILTER (action = 'exit_block'), arg_min(reason, place) FILTER (action = 'stderr_only'), 'symbolic_checks_passed') AS reason
          FROM (SELECT user_id, event_id AS place, 'r' || event_id AS reason, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'exit_block' WHEN event_id % 9 = 0 THEN 'stderr_only' ELSE 'allow' END AS action FROM events)
          GROUP BY user_id""")  # fmt: skip
def file_verdicts(spark, sf_dir):
    i = F.col("event_id")
    action = F.when((F.col("event_type") == "error") & (i % 5 == 0), "exit_block").when(i % 9 == 0, "stderr_only").otherwise("allow")
    rows = events(spark, sf_dir).select(F.col("user_id").alias("path"), i.alias("place"), action.alias("action"), F.concat(F.lit("r"), i.cast("string")).alias("reason"), F.lit("rules").alias("source"))
    return S.file_verdicts(rows, "path").drop("source")


PLAN_PARTS = (
    "\n# Phase 1\n- src/app.py ~ 450 LOC\n* `tests/test_x.py`: ~250 lines\n## Step 2\nsee `lib/a.ts` and core/db.go:42", "\n### Phase one\n### Phase two\n- Dockerfile", " across both services, README and src/Makefile",
    "\n+ web/big.vue about 1300 lines\n.gitignore .env.local x.env", " a single test that covers both, MyDockerfile", "",
)
OUTLINES = f"outlines AS (SELECT conv_id, turn, coalesce(text, '') || {_chosen(PLAN_PARTS, 'turn + ascii(right(CAST(conv_id AS VARCHAR), 1))')} AS text FROM conversations)"
_names = lambda xs: "(?:^|[^A-Za-z0-9_.\\-])(" + "|".join(r"(?:[A-Za-z0-9_.\-]+/)?" + x.replace(".", r"\.").replace("-", r"\-") for x in xs) + ")(?:[^A-Za-z0-9_.\\-]|$)"  # noqa: E731  no look-around: delimiters are doubled
_ALL = f"""list_sort(list_distinct(flatten([regexp_extract_all(text, '{S.FILE_LINE}', 1), regexp_extract_all(text, '{S.QUOTED_PATH}', 1), regexp_extract_all(text, '{S.LINE_REF}', 1),
           regexp_extract_all(twice, '{_names(S.BARE_NAMES)}', 1), regexp_extract_all(twice, '{_names(sorted(S.DOT_FILES, key=len, reverse=True))}', 1)])))"""


@query(rf"""SELECT conv_id, turn, array_to_string(paths, ' ') AS paths, CAST(n_phases AS INTEGER) AS n_phases, CAST(len(list_filter(loc, lambda x: x > 1200)) AS INTEGER) AS over_block,
                   CAST(len(list_filter(range(1, len(loc) + 1), lambda i: loc[i] <= 1200 AND loc[i] > CASE WHEN contains(file[i], 'test_') OR contains(file[i], '/tests/') THEN 200 ELSE 400 END)) AS INTEGER) AS over_budget,
                   n_phases > 0 AND len(paths) > 0 AND n_phases > len(paths) AS thin, {" OR ".join(f"regexp_matches(text, '{p}')" for p in S.BOUNDARY)} AS boundary
            FROM (SELECT conv_id, turn, text, {_ALL} AS paths, len(regexp_extract_all(text, '{S.PHASE}')) AS n_phases, regexp_extract_all(text, '{S.FILE_LINE}', 1) AS file,
                         list_transform(regexp_extract_all(text, '{S.FILE_LINE}', 2), lambda x: CAST(x AS INTEGER)) AS loc
                  FROM (SELECT *, regexp_replace(text, '([^A-Za-z0-9_.\-/])', '\1\1', 'g') AS twice FROM outlines))""", OUTLINES)  # fmt: skip
def plan_findings(spark, sf_dir):
    part = dealt(PLAN_PARTS, F.col("turn") + F.ascii(F.substring(F.col("conv_id").cast("string"), -1, 1)))
    text = F.concat(F.coalesce("text", F.lit("")), part)
    got = S.plan_findings(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(S.plan_paths(text), " ").alias("paths"), *[got[k].alias(k) for k in ("n_phases", "over_block", "over_budget", "thin", "boundary")])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber LIMIT 5000")
def first_functions(spark, sf_dir):
    """The index's cap is the feature."""
    return S.first_functions(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey", "l_orderkey", "l_linenumber"])


_SHARE = "CAST('0x' || substr(md5(doc_id || 't7'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"SELECT doc_id, doc_id = (SELECT doc_id FROM documents ORDER BY {_SHARE}, doc_id LIMIT 1) AS picked FROM documents WHERE {_SHARE} < 0.05")
def prompted_documents(spark, sf_dir):
    """A share of 5 % is the feature; so is the one that is picked."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    one = S.picked(d, "doc_id", "t7").withColumn("picked", F.lit(True))
    return S.prompted(d, "doc_id", "t7").join(F.broadcast(one), "doc_id", "left").select("doc_id", F.coalesce("picked", F.lit(False)).alias("picked"))


ANSWERS = """answers AS (SELECT o_orderkey, o_orderpriority AS category, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 2 END AS j1, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 3 END AS j2,
                                CASE WHEN o_orderkey % 7 > 1 THEN o_custkey % 2 END AS j3, o_custkey % 2 AS label FROM orders WHERE o_orderpriority IS NOT NULL)"""


@query("""SELECT category, count(*) AS n, count(CASE WHEN j1 IS NULL AND j2 IS NULL AND j3 IS NULL THEN 1 END) AS unreachable,
                 count(CASE WHEN m IS NULL AND NOT (j1 IS NULL AND j2 IS NULL AND j3 IS NULL) THEN 1 END) AS no_majority, count(m) AS total,
                 count(CASE WHEN m = label THEN 1 END) AS agree, count(CASE WHEN m <> label THEN 1 END) AS disagree, round(count(CASE WHEN m = label THEN 1 END) / CAST(nullif(count(m), 0) AS DOUBLE), 6) AS rate
          FROM (SELECT *, CASE WHEN j1 = j2 OR j1 = j3 THEN j1 WHEN j2 = j3 THEN j2 END AS m FROM answers) GROUP BY ROLLUP (category)""", ANSWERS)  # fmt: skip
def judge_agreement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority is not null")
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(F.col("o_orderpriority").alias("category"), F.when(key % 4 > 0, c % 2).alias("j1"), F.when(key % 5 > 0, c % 3).alias("j2"), F.when(key % 7 > 1, c % 2).alias("j3"), (c % 2).alias("label"))
    return S.agreement(rows, "category", ["j1", "j2", "j3"], "label", E.majority(F.array("j1", "j2", "j3"))).withColumn("rate", F.round("rate", 6))


@query("""SELECT behaviour, n AS pairs, control_escapes, treatment_escapes FROM (SELECT 'b' || o_custkey % 400 AS behaviour, count(CASE WHEN o_orderkey % 2 = 1 THEN 1 END) AS n, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS t,
                 count(CASE WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'F' THEN 1 END) AS control_escapes, count(CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 1 END) AS treatment_escapes FROM orders GROUP BY 1) WHERE n = t""")  # fmt: skip
def behaviour_clusters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    arm = F.when(F.col("o_orderkey") % 2 == 1, "control").otherwise("treatment")
    rows = o.select(F.concat(F.lit("b"), (F.col("o_custkey") % 400).cast("string")).alias("behaviour"), arm.alias("arm"), (F.col("o_orderstatus") == "F").alias("escaped"))
    return S.behaviour_clusters(rows, "behaviour", "arm", "escaped")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered,
                 NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30 AND o_totalprice <= c_acctbal * 60) AS none_in_range FROM customer""")
def semi_and_anti_joins(spark, sf_dir):
    """Semi and anti joins, one with a range beside the key; Spark chooses how."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    yes = c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("ordered"))
    inside = (c["c_custkey"] == o["c_custkey"]) & (o["o_totalprice"] > c["c_acctbal"] * 30) & (o["o_totalprice"] <= c["c_acctbal"] * 60)
    no = c.join(o, inside, "left_anti").select("c_custkey", F.lit(True).alias("none"))
    return c.select("c_custkey").join(yes, "c_custkey", "left").join(no, "c_custkey", "left").select("c_custkey", F.coalesce("ordered", F.lit(False)).alias("ordered"), F.coalesce("none", F.lit(False)).alias("none_in_range"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, TRUE AS near FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def grouping_sets(spark, sf_dir):
    """Cube with exact and approximate distinct counts; near: within a tenth of each other.
    The cube is of the suppliers of each finest group, counted first: as many rows as there are of those, not of lines."""
    exact, rough = F.countDistinct("l_suppkey"), F.approx_count_distinct("l_suppkey", 0.02)
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count(F.lit(1)).alias("__n"))
    return counted.cube("l_returnflag", "l_linestatus").agg(
        F.grouping_id().alias("level"), F.sum("__n").alias("n"), exact.alias("n_suppliers"), (F.abs(rough - exact) <= 0.1 * exact).alias("near")
    )


@query("""SELECT o_orderkey, ntile(4) OVER w AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank, round(percent_rank() OVER w, 6) AS share,
                 round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS around
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")  # fmt: skip
def ranks_and_frames(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("priority_rank"),
        F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 1)), 2).alias("around"),
    )


@query("""SELECT l_suppkey, l_partkey, count(*) AS n FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R') GROUP BY ALL""")
def multiset_intersection(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    side = lambda c: l.where(c).select("l_suppkey", "l_partkey")
    return side("l_returnflag = 'R'").intersectAll(side("l_returnflag <> 'R'")).groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
