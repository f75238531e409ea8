"""Queries over histories; orders and their lines stand in for commits and the files they touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import commits as C
from ledgerline.operators import evidence as V
from ledgerline.operators import history as H
from ledgerline.plans.collect import collection

TOUCH = "touch AS (SELECT DISTINCT o_orderkey AS sha, l_partkey AS file, o_orderdate AS ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
QUERIES, ORACLES, query = collection(TOUCH)


def touches(spark, sf_dir):
    """Not distinct: what is made of them counts a file of a commit once."""
    o, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))  # noqa: E741
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("sha"), F.col("l_partkey").alias("file"), F.col("o_orderdate").alias("ts"))


@query("""SELECT sha, count(DISTINCT file) AS n_files FROM touch a WHERE EXISTS (SELECT 1 FROM touch b WHERE b.file = a.file AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 48 HOUR) GROUP BY sha""")
def followed_up_commits(spark, sf_dir):
    return H.followed_up(touches(spark, sf_dir))


@query("""SELECT a.sha, a.sha - 1 AS target, CAST(len(list_intersect(a.files, b.files)) AS INTEGER) AS n_shared
          FROM (SELECT sha, list(file) AS files FROM touch GROUP BY sha) a JOIN (SELECT sha, list(file) AS files FROM touch GROUP BY sha) b ON b.sha = a.sha - 1 WHERE a.sha % 3 = 0""")  # fmt: skip
def reverted_commits(spark, sf_dir):
    kind = F.when(F.col("sha") % 3 == 0, "revert").otherwise("other")
    commits = touches(spark, sf_dir).groupBy("sha").agg(F.collect_set("file").alias("files")).select("sha", kind.alias("kind"), (F.col("sha") - 1).alias("target"), "files")
    return H.follow_pairs(commits, "revert").select("sha", "target", F.size("shared").alias("n_shared"))


@query("SELECT source, count(*) AS n, count(*) >= greatest(1, floor(sum(count(*)) OVER () * 0.10::DOUBLE)) AS home FROM documents GROUP BY source", "")
def language_families(spark, sf_dir):
    return H.language_families(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source")


@query("""SELECT path, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'changed' END AS change
          FROM (SELECT p_partkey AS path, p_size AS b FROM part WHERE p_partkey % 5 > 0) FULL JOIN (SELECT p_partkey AS path, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS a FROM part WHERE p_partkey % 7 > 0) USING (path)
          WHERE b IS DISTINCT FROM a""", "")  # fmt: skip
def snapshot_changes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("digest"))
    after = p.where("path % 7 > 0").withColumn("digest", F.when(F.col("digest") > 40, 0).otherwise(F.col("digest")))
    return H.snapshot_changes(p.where("path % 5 > 0"), after)


@query("""SELECT event_type AS kind, user_id AS path, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS id FROM events GROUP BY 1, 2""", "")
def first_violations(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return H.first_seen(e.select(F.col("event_type").alias("kind"), F.col("user_id").alias("path"), "ts", F.col("event_id").alias("id")))


@query("""SELECT l_orderkey, count(CASE WHEN s >= 4 THEN 1 END) AS n_high, count(CASE WHEN s <= 2 THEN 1 END) AS n_low,
                 CASE WHEN n_high > n_low THEN 1 WHEN n_high < n_low THEN 0 ELSE CAST(avg(s) >= 4 AS INTEGER) END AS resolved,
                 CASE WHEN n_low > n_high THEN 1 WHEN n_low < n_high THEN 0 ELSE CAST(avg(s) <= 2 AS INTEGER) END AS regressed
          FROM (SELECT l_orderkey, 1 + l_partkey % 5 AS s FROM lineitem) GROUP BY l_orderkey""", "")  # fmt: skip
def judged_outcomes(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (1 + F.col("l_partkey") % 5).alias("s"))
    return H.judged_outcome(scores, "l_orderkey", "s")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 3 = 0 THEN 'clean' WHEN o_orderkey % 4 = 1 THEN 'gap' ELSE 'infrastructure' END AS outcome FROM orders""", "")
def session_outcomes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", H.session_outcome(F.col("o_orderkey") % 4, F.col("o_custkey") % 3).alias("outcome"))


@query("""SELECT c.conv_id AS sha, c.turn AS claim_no, coalesce(min(CASE WHEN contains(lower(c.text), lower(h.stem)) THEN h.hunk_no END), any_value(c.turn % n)) AS hunk_no
          FROM conversations c JOIN (SELECT conv_id, turn AS hunk_no, string_split(text, ' ')[2] AS stem, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) h USING (conv_id)
          GROUP BY c.conv_id, c.turn""", "")  # fmt: skip
def grounded_claims(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    hunks = c.select(F.col("conv_id").alias("sha"), F.col("turn").alias("hunk_no"), F.try_element_at(F.split("text", " "), F.lit(2)).alias("stem"))
    return H.file_claims(c.select(F.col("conv_id").alias("sha"), F.col("turn").alias("claim_no"), F.col("text").alias("claim")), hunks)


@query("""SELECT id, other_id FROM (SELECT a.id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY (b.place - a.place + a.n) % a.n) AS nth
            FROM placed a JOIN placed b ON a.sha <> b.sha AND a.file <> b.file) WHERE nth = 1""",
       """placed AS (SELECT doc_id AS id, source AS sha, lang AS file, row_number() OVER (ORDER BY md5(doc_id || 'n1'), doc_id) AS place, count(*) OVER () AS n
                     FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)""")  # fmt: skip
def shuffled_negatives(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("sha"), F.col("lang").alias("file"))
    return H.shuffled_negatives(d, "n1")


#: commits of the stand-in graph, five projects of a main line, a branch of two at every commit of it, and merges;
#: some clocks are five hours slow
SPAN = 30
_GRAPH = """graph AS (SELECT o_orderkey AS k, o_orderkey % 5 AS p, o_orderkey // 5 AS j, o_custkey FROM orders),
par AS (SELECT k, p, q * 5 + p AS parent FROM (SELECT k, p, unnest(CASE WHEN j % 27 = 0 THEN [j - 3, j - 1, j - 10] WHEN j % 9 = 0 THEN [j - 3, j - 1] WHEN j % 3 = 0 THEN [j - 3] ELSE [j - 1] END) AS q FROM graph) WHERE q >= 0),
heads AS (SELECT k AS b, k + 5 * (o_custkey % 30) AS a, o_custkey % 10 AS file FROM graph WHERE k + 5 * (o_custkey % 30) IN (SELECT k FROM graph)),
reach(b, a, c) AS (SELECT b, a, a FROM heads UNION SELECT b, a, parent FROM reach JOIN par ON par.k = c WHERE parent >= b),
below(b, a, c) AS (SELECT b, a, b FROM heads UNION SELECT b, a, k FROM below JOIN par ON parent = c WHERE k <= a),
lies AS (SELECT b, a, c FROM reach JOIN below USING (b, a, c) WHERE c <> b)"""


def commit_graph(spark, sf_dir):
    k = F.col("o_orderkey")
    p, j = k % 5, F.floor(k / 5)
    parents = F.when(j % 27 == 0, F.array(j - 3, j - 1, j - 10)).when(j % 9 == 0, F.array(j - 3, j - 1)).when(j % 3 == 0, F.array(j - 3)).otherwise(F.array(j - 1))
    parents = F.transform(F.filter(parents, lambda x: x >= 0), lambda x: (x * 5 + F.lit(p)).cast("string"))
    touched = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.expr("bit_or(shiftleft(1, cast(l_suppkey % 10 as int)))").alias("bits"))
    files = touched.select("o_orderkey", F.expr("transform(filter(sequence(0, 9), x -> (bits & shiftleft(1, x)) > 0), x -> cast(x as string))").alias("files"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(files, "o_orderkey", "left")
    clock = j * 3600 - F.when(j % 50 == 7, 18_000).otherwise(0)
    return orders.select(p.cast("string").alias("project"), k.cast("string").alias("sha"), parents.alias("parents"), clock.alias("ts"), F.lit("c").alias("message"), "files")


def decisions_with_heads(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x, name: x.cast("string").alias(name)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("decision_id"), s(k % 5, "project"), s(k, "git_head_before"), s(k + 5 * (c % SPAN), "git_head_after"), s(c % 10, "file_path_rel"))


@query("SELECT b, a, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS shas FROM lies GROUP BY b, a", f"RECURSIVE {_GRAPH}")
def commits_in_head_range(spark, sf_dir):
    """The commits between the heads of each decision, counted, and the sum of their keys."""
    heads = decisions_with_heads(spark, sf_dir).select("project", F.col("git_head_before").alias("before"), F.col("git_head_after").alias("after"))
    found = C.commits_between(commit_graph(spark, sf_dir), heads).groupBy("before", "after")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sha").cast("long")).alias("shas")).select(F.col("before").cast("long").alias("b"), F.col("after").cast("long").alias("a"), "n", "shas")


@query("""SELECT DISTINCT b AS decision_id, c AS sha, (c // 5) * 3600 - CASE WHEN (c // 5) % 50 = 7 THEN 18000 ELSE 0 END AS ts, 'exact_head_range' AS link_confidence
          FROM lies JOIN heads USING (b, a) JOIN lineitem ON l_orderkey = c AND l_suppkey % 10 = file""", f"RECURSIVE {_GRAPH}")  # fmt: skip
def decision_commits(spark, sf_dir):
    linked = C.linked_commits(decisions_with_heads(spark, sf_dir), commit_graph(spark, sf_dir))
    return linked.select("decision_id", F.col("sha").cast("long").alias("sha"), "ts", "link_confidence")


#: an audit log of the same projects: a session is 200 orders, its outcomes carry the head it ended with
_EVENTS = ("", "", "note", "verification_recorded", "", "session_started", "session_outcome_recorded")
_SAID = ("allowed", "blocked", "warn", "skipped", "shadow_blocked", None)
_TOOLS = ("Bash", "Edit", "Write", None, "Read")
_said = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
_TRAIL = f"""trail AS (SELECT o_orderkey AS id, '/home/p' || o_orderkey % 5 AS project, 's' || o_orderkey // 200 AS session, {_said(_EVENTS)}[1 + o_orderkey % 7] AS event_type, {_said(_SAID)}[1 + o_custkey % 6] AS said,
        {_said(_TOOLS)}[1 + o_custkey % 5] AS tool, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 10 END AS file, o_orderkey - 5 * (1 + o_custkey % 3) AS parent, ['failed', 'passed'][1 + o_custkey % 2] AS status FROM orders),
    decided AS (SELECT *, event_type NOT IN ('verification_recorded', 'session_started', 'session_outcome_recorded') AND file IS NOT NULL
        AND (coalesce(said IN ('allowed', 'blocked', 'warn', 'shadow_blocked'), FALSE) OR coalesce(tool IN ('Edit', 'Write'), FALSE)) AS is_decision FROM trail)"""


def audit_events(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    chosen = lambda xs, by: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (by % len(xs) + 1).cast("int"))
    kind = chosen(_EVENTS, k)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        s(k).alias("decision_id"), F.concat(F.lit("/home//p"), s(k % 5)).alias("project_dir"), F.concat(F.lit("s"), s(F.floor(k / 200))).alias("session_id"), kind.alias("event_type"), chosen(_SAID, c).alias("decision"),
        chosen(_TOOLS, c).alias("tool_name"), F.when(c % 11 > 0, s(c % 10)).alias("file_path"), F.when(c % 11 > 0, s(c % 10)).alias("file_path_rel"), s(k - 5 * (1 + c % 3)).alias("parent_decision_id"),
        chosen(("failed", "passed"), c).alias("verification_status"), s(k).alias("git_head_before"), s(k).alias("git_head_after"), F.lpad(s(k), 9, "0").alias("ts"), F.concat(F.lit("o"), s(k)).alias("outcome_status"),
    )


@query("SELECT id, is_decision FROM decided", _TRAIL)
def decisions_told_apart(spark, sf_dir):
    return V.keyed(audit_events(spark, sf_dir)).select(F.col("decision_id").cast("long").alias("id"), "is_decision")


@query("""SELECT project, session, count_if(is_decision) AS decision_count, count_if(event_type = 'verification_recorded') AS verification_count, count_if(event_type = 'session_outcome_recorded') AS outcome_count
          FROM decided GROUP BY project, session""", _TRAIL)  # fmt: skip
def session_evidence(spark, sf_dir):
    return V.session_rollup(audit_events(spark, sf_dir))


_LEDGER = f"""{_TRAIL},
checks AS (SELECT project, session, parent AS id, count(*) AS n_checks, count_if(status = 'failed') AS n_failed FROM trail WHERE event_type = 'verification_recorded' GROUP BY ALL),
ends AS (SELECT project, session, max(id) AS head FROM trail WHERE event_type = 'session_outcome_recorded' GROUP BY ALL),
made AS (SELECT d.*, head FROM decided d LEFT JOIN ends USING (project, session) WHERE is_decision),
graph AS (SELECT o_orderkey AS k, o_orderkey % 5 AS p, o_orderkey // 5 AS j FROM orders),
par AS (SELECT k, p, q * 5 + p AS parent FROM (SELECT k, p, unnest(CASE WHEN j % 27 = 0 THEN [j - 3, j - 1, j - 10] WHEN j % 9 = 0 THEN [j - 3, j - 1] WHEN j % 3 = 0 THEN [j - 3] ELSE [j - 1] END) AS q FROM graph) WHERE q >= 0),
reach(b, a, c) AS (SELECT id, head, head FROM made WHERE head > id UNION SELECT b, a, par.parent FROM reach JOIN par ON par.k = c WHERE par.parent >= b),
below(b, a, c) AS (SELECT id, head, id FROM made WHERE head > id UNION SELECT b, a, k FROM below JOIN par ON par.parent = c WHERE k <= a),
linked AS (SELECT b AS id, count(DISTINCT c) AS n_commits FROM reach JOIN below USING (b, a, c) JOIN made ON made.id = b JOIN lineitem ON l_orderkey = c AND l_suppkey % 10 = file WHERE c <> b GROUP BY b),
labelled AS (SELECT doc_id AS id, count(*) AS n_labels FROM labels GROUP BY doc_id),
ledger AS (SELECT id, project, session, said, coalesce(n_labels, 0) AS n_labels, coalesce(n_checks, 0) AS n_checks, coalesce(n_failed, 0) AS n_failed, coalesce(n_commits, 0) AS n_commits, head IS NOT NULL AS ended, 'o' || head AS outcome
           FROM made LEFT JOIN checks USING (project, session, id) LEFT JOIN linked USING (id) LEFT JOIN labelled USING (id))"""


def _ledger(spark, sf_dir):
    graph = commit_graph(spark, sf_dir).withColumn("project", F.concat(F.lit("/home/p"), "project"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("decision_id"))
    return V.evidence_ledger(audit_events(spark, sf_dir), labels, graph)


@query("""SELECT id, session, n_labels, n_checks, n_failed, n_commits, outcome, CASE WHEN n_checks > 0 OR n_commits > 0 THEN 'strong' WHEN n_labels > 0 OR ended THEN 'partial' ELSE 'unlinked' END AS grade FROM ledger""", f"RECURSIVE {_LEDGER}")
def evidence_of_decisions(spark, sf_dir):
    got = _ledger(spark, sf_dir)
    return got.select(F.col("decision_id").cast("long").alias("id"), "session", "n_labels", "n_checks", "n_failed", "n_commits", "outcome", "grade")


@query("""SELECT count(*) AS decisions, count_if(n_labels > 0) AS labelled, count_if(n_checks > 0) AS exact_links, count_if(n_commits > 0) AS commit_links,
                 count_if(said IN ('allowed', 'warn') AND n_failed > 0) AS failed_links, count_if(said IN ('blocked', 'shadow_blocked') AND n_checks > n_failed) AS blocked_pass_links FROM ledger""", f"RECURSIVE {_LEDGER}")  # fmt: skip
def evidence_totals(spark, sf_dir):
    return V.evidence_summary(_ledger(spark, sf_dir))
