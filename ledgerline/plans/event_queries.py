"""Queries over the decision log; the `events` table stands in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import decisions as D
from ledgerline.operators.experiments import exact_quantiles
from ledgerline.plans.collect import collection

TODAY, START, END = "2024-01-30", "2024-01-05", "2024-01-20"

#: the log in SQL, for the oracles
LOG = """log AS (
    SELECT event_id AS decision_id, user_id AS session_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS checksum,
           'src/m' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 || CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN '.py' ELSE '.ts' END AS file_path,
           CASE event_type WHEN 'error' THEN 'block' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'check' ELSE 'allow' END AS decision,
           CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'drift' ELSE 'rule' END AS signal_source,
           CAST(floor(value * 10) AS BIGINT) AS latency_ms,
           event_id - 1 - CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS parent_id,
           CASE WHEN event_id % 3 > 0 THEN event_id // 10 END AS batch_id
    FROM events)"""

RETRY = """retried AS (
    SELECT *, coalesce(epoch_us(ts) - epoch_us(last_value(CASE WHEN decision = 'block' THEN ts END IGNORE NULLS) OVER (
        PARTITION BY session_id, file_path ORDER BY ts, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) <= 7200000000, FALSE) AS retry_after_block
    FROM log)"""
#: the test log is sparse: two hours in place of two minutes
RETRY_SECONDS = 7200


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    return events.select(
        F.col("event_id").alias("decision_id"),
        F.col("user_id").alias("session_id"),
        "ts",
        k.alias("checksum"),
        F.concat(F.lit("src/m"), (k % 7).cast("string"), F.when(k % 3 == 0, ".py").otherwise(".ts")).alias("file_path"),
        F.when(kind == "error", "block").when(kind == "signup", "warn").when(kind == "purchase", "check").otherwise("allow").alias("decision"),
        F.when(k % 4 == 0, "contract").when(k % 4 == 1, "drift").otherwise("rule").alias("signal_source"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
        (F.col("event_id") - 1 - k % 5).alias("parent_id"),
        F.when(F.col("event_id") % 3 > 0, F.floor(F.col("event_id") / 10)).alias("batch_id"),
    )


def retried_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_retry(decision_log(spark, sf_dir), RETRY_SECONDS)


QUERIES, ORACLES, query = collection(LOG)


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_sessions,
                 round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
                 CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum
          FROM events GROUP BY event_type""", "")  # fmt: skip
def gate_benchmark(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_sessions"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))
    values = exact_quantiles(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return counts.join(values.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")), "event_type", "left")


#: decisions, reasons, gates and sources of the stand-in audit trail, dealt by the events' ids and numbers
DECISIONS = ("allowed", "blocked", "warn", "shadow_blocked", "fail-open", "Operator_Override", "allowed_via_override", "exit_block", "blocked")
REASONS = (
    "plan_impl_drift", "contract_violation: phase", "oracle_syntax", "ruff ORACLE failed", "rule_engine:no-eval", "shell_escape", "kill_switch_on", "magic_comment", "no plan yet",
    "sidecar_unavailable: refused", "not_in_plan", "hard_cap_exceeded", "non_loopback peer", "unknown_symbol x", "loc_budget", "language_mismatch", "", None, "guard_file_locked", "fan_in high",
)
GATES = ("rules", "plan_grounding", None, "drift")
SOURCES = ("plan_grounding", "novelty", "Plan_Quality", "bm25_fallback", "vector", None, "forbid_import", "phase_ratio")
_sql = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
AUDIT = f"""audit AS (
    SELECT event_id AS decision_id, ts, 'src/m' || {_K} % 7 AS file_path, {_sql(DECISIONS)}[1 + event_id % {len(DECISIONS)}] AS decision,
           {_sql(REASONS)}[1 + ({_K} + event_id // 7) % {len(REASONS)}] AS reason, {_sql(GATES)}[1 + {_K} % {len(GATES)}] AS gate_id,
           {_sql(SOURCES)}[1 + ({_K} + event_id) % {len(SOURCES)}] AS signal_source, {_K} % 5 = 0 AS retry_after_block,
           CASE WHEN event_id % 17 > 0 THEN CAST(floor(value * 10) AS BIGINT) END AS latency_ms FROM events)"""


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, e = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    dealt = lambda xs, by: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (by % len(xs) + 1).cast("int"))
    return events.select(
        e.alias("decision_id"), "ts", F.concat(F.lit("src/m"), (k % 7).cast("string")).alias("file_path"), dealt(DECISIONS, e).alias("decision"),
        dealt(REASONS, k + F.floor(e / 7)).alias("reason"), dealt(GATES, k).alias("gate_id"), dealt(SOURCES, k + e).alias("signal_source"),
        (k % 5 == 0).alias("retry_after_block"), F.when(e % 17 > 0, F.floor(F.col("value") * 10).cast("long")).alias("latency_ms"),
    )


_COUNTS = ", ".join(f"count_if(decision = '{d}') AS {c}" for d, c in (("blocked", "blocked"), ("warn", "warn"), ("shadow_blocked", "shadow_blocked"), ("fail-open", "fail_open"), ("allowed", "allowed"), ("allowed_via_override", "allowed_via_override"), ("operator_override", "operator_override"), ("operator_confirmed", "operator_confirmed")))


@query(f"""SELECT *, CAST(round(n_events + 1.5 * (blocked + warn + shadow_blocked + allowed_via_override), 1) AS DOUBLE) AS token_cost,
                  least(1.0::DOUBLE, round(CAST(retried + allowed_via_override AS DOUBLE) / nullif(blocked + shadow_blocked, 0), 3)) AS false_positive_proxy
           FROM (SELECT signal_source, count(*) AS n_events, {_COUNTS}, count_if(decision = 'blocked' AND retry_after_block) AS retried, count_if(creep) AS scope_creep,
                        count_if(creep AND decision IN ('blocked', 'shadow_blocked')) AS scope_creep_blocked, count_if(creep AND decision NOT IN ('blocked', 'shadow_blocked')) AS scope_creep_warned,
                        CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS median_ms, CAST(floor(quantile_cont(latency_ms, 0.95)) AS BIGINT) AS p95_ms,
                        CAST(floor(quantile_cont(CASE WHEN decision = 'blocked' THEN latency_ms END, 0.5)) AS BIGINT) AS median_block_ms
                 FROM (SELECT *, coalesce(reason = 'plan_impl_drift' OR contains(lower(reason), 'contract_violation'), FALSE) AS creep FROM audit) GROUP BY signal_source)""", AUDIT)  # fmt: skip
def benchmark_by_source(spark, sf_dir):
    return D.benchmark(audit_trail(spark, sf_dir), ["signal_source"])


@query("""SELECT severity, count(*) AS n FROM (SELECT CASE WHEN d = 'fail-open' THEN 'fail_open' WHEN d = 'shadow_blocked' THEN 'shadow' WHEN d IN ('operator_override', 'allowed_via_override') THEN 'override'
                 WHEN contains(r, 'contract_violation') THEN 'contract' WHEN contains(r, 'oracle') THEN 'oracle' WHEN starts_with(r, 'rule_engine:') THEN 'rule_engine'
                 WHEN r = 'plan_impl_drift' THEN 'plan_grounding' WHEN r IN ('shell_escape', 'guard_file_locked', 'language_fingerprint_violation') OR starts_with(r, 'kill_switch') OR starts_with(r, 'magic_comment') THEN 'self_protection'
                 WHEN gate_id = 'plan_grounding' OR contains(r, 'plan') THEN 'plan_grounding' WHEN gate_id = 'rules' THEN 'rule_engine' ELSE 'other' END AS severity
          FROM (SELECT *, lower(decision) AS d, lower(coalesce(reason, '')) AS r FROM audit WHERE decision <> 'allowed')) GROUP BY severity""", AUDIT)  # fmt: skip
def severity_counts(spark, sf_dir):
    return D.severity_counts(audit_trail(spark, sf_dir))


@query("""SELECT n_events, caught, false_drifts, round(greatest(0, caught - false_drifts) / (ms / 1000.0::DOUBLE + 1) * 0.43::DOUBLE * greatest(0.0::DOUBLE, 1 - away / CAST(n_events AS DOUBLE)), 8) AS score
          FROM (SELECT count(*) AS n_events, count_if(drift) AS caught, count_if(drift AND ((retry_after_block AND decision = 'blocked') OR decision_id % 11 = 0)) AS false_drifts,
                       sum(latency_ms) AS ms, count_if(reason LIKE 'sidecar_unavailable%') AS away
                FROM (SELECT *, coalesce(reason = 'plan_impl_drift', FALSE) AND decision IN ('blocked', 'warn', 'shadow_blocked') AS drift FROM audit))""", AUDIT)  # fmt: skip
def gate_efficiency(spark, sf_dir):
    log = audit_trail(spark, sf_dir)
    return D.efficiency(log, log.where("decision_id % 11 = 0").select("file_path", "decision_id"))


@query("""SELECT decision_id, CASE WHEN d = 'fail-open' THEN 'fail_open' WHEN d = 'shadow_blocked' THEN 'shadow' WHEN d IN ('operator_override', 'allowed_via_override') THEN 'override'
                 WHEN contains(r, 'contract_violation') THEN 'contract' WHEN contains(r, 'oracle') THEN 'oracle' WHEN starts_with(r, 'rule_engine:') THEN 'rule_engine'
                 WHEN r = 'plan_impl_drift' THEN 'plan_grounding' WHEN r IN ('shell_escape', 'guard_file_locked', 'language_fingerprint_violation') THEN 'self_protection'
                 WHEN starts_with(r, 'kill_switch') OR starts_with(r, 'magic_comment') THEN 'self_protection' WHEN gate_id = 'plan_grounding' OR contains(r, 'plan') THEN 'plan_grounding'
                 WHEN gate_id = 'rules' THEN 'rule_engine' ELSE 'other' END AS severity
          FROM (SELECT *, lower(decision) AS d, lower(coalesce(reason, '')) AS r FROM audit) WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-05' AND strftime(ts, '%Y-%m-%d') < '2024-01-20'""", AUDIT)  # fmt: skip
def severity_in_window(spark, sf_dir):
    log = D.in_window(audit_trail(spark, sf_dir), START, END)
    return log.select("decision_id", D.severity(F.col("reason"), F.col("decision"), F.col("gate_id")).alias("severity"))


@query("SELECT decision_id, retry_after_block FROM retried", f"{LOG}, {RETRY}")
def retry_after_block(spark, sf_dir):
    return retried_log(spark, sf_dir).select("decision_id", "retry_after_block")


@query("""SELECT count(*) AS overrides, count_if(d = c) AS survived, count_if(d <> c) AS reverted, count_if(d IS NULL OR c IS NULL) AS unknown,
                 round(count_if(d = c) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS survival_ratio, round(count_if(d <> c) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS reverted_ratio
          FROM (SELECT CASE WHEN decision_id % 10 > 0 THEN decision_id % 3 END AS d, CASE WHEN file_path <> 'src/m6' THEN CAST(right(file_path, 1) AS INTEGER) % 3 END AS c FROM audit WHERE decision = 'allowed_via_override')""", AUDIT)  # fmt: skip
def override_survival(spark, sf_dir):
    i = F.col("decision_id")
    log = audit_trail(spark, sf_dir).withColumn("digest", F.when(i % 10 > 0, i % 3))
    current = spark.createDataFrame([(f"src/m{k}", k % 3) for k in range(6)], "file_path string, digest long")
    return D.override_survival(log, current)


LEDGER = """linked AS (
    SELECT e.decision_id, e.session_id, coalesce(n_labels, 0) AS n_labels, coalesce(n_checks, 0) AS n_checks, CASE WHEN e.decision_id % 13 = 0 THEN 2 ELSE 0 END AS n_commits, outcome,
           CASE WHEN n_checks IS NOT NULL OR e.decision_id % 13 = 0 THEN 'strong' WHEN n_labels IS NOT NULL OR outcome IS NOT NULL THEN 'partial' ELSE 'unlinked' END AS grade
    FROM (SELECT * FROM ended WHERE decision NOT IN ('check', 'end')) e
    LEFT JOIN (SELECT doc_id AS decision_id, count(*) AS n_labels FROM labels GROUP BY 1) l ON l.decision_id = e.decision_id
    LEFT JOIN (SELECT session_id, parent_id, count(*) AS n_checks FROM ended WHERE decision = 'check' GROUP BY 1, 2) c
           ON c.session_id = e.session_id AND c.parent_id = e.decision_id
    LEFT JOIN (SELECT session_id, arg_max(checksum, (ts, decision_id)) AS outcome FROM ended WHERE decision = 'end' GROUP BY 1) o ON o.session_id = e.session_id),
"""
ENDED = "ended AS (SELECT * REPLACE (CASE WHEN decision = 'block' AND checksum > 90 THEN 'end' WHEN decision = 'check' THEN 'check' ELSE decision END AS decision, CASE WHEN decision = 'check' THEN decision_id - 150 ELSE parent_id END AS parent_id) FROM log)"


def _ledger(spark, sf_dir):
    log = decision_log(spark, sf_dir)
    d = F.when((F.col("decision") == "block") & (F.col("checksum") > 90), "end").otherwise(F.col("decision"))
    log = log.withColumn("parent_id", F.when(F.col("decision") == "check", F.col("decision_id") - 150).otherwise(F.col("parent_id"))).withColumn("decision", d)
    commits = log.where("decision_id % 13 = 0").select("decision_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("decision_id"))
    return D.ledger(log, labels, commits.unionByName(commits)), log


@query("""SELECT session_id, count_if(decision NOT IN ('check', 'end')) AS decisions, count_if(decision = 'check') AS verifications, count_if(decision = 'end') AS outcomes, count_if(decision = 'block') AS blocked,
                 count_if(decision = 'warn') AS warned, count(DISTINCT file_path) AS n_files, min(ts) AS first_ts, max(ts) AS last_ts FROM ended GROUP BY session_id""", f"{LOG}, {ENDED}")  # fmt: skip
def session_rollup(spark, sf_dir):
    return D.session_rollup(_ledger(spark, sf_dir)[1])


@query("SELECT * FROM linked", f"{LOG}, {ENDED}, {LEDGER.rstrip().rstrip(',')}")
def decision_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)[0]


@query("""SELECT count(*) AS decisions, round(count_if(n_labels > 0) / CAST(count(*) AS DOUBLE), 6) AS label_rate, round(count_if(n_checks > 0) / CAST(count(*) AS DOUBLE), 6) AS exact_verification_rate,
                 round(count_if(n_commits > 0) / CAST(count(*) AS DOUBLE), 6) AS commit_link_rate, (SELECT count(DISTINCT session_id) FROM ended) AS sessions,
                 round((SELECT count(DISTINCT session_id) FROM ended WHERE decision = 'end') / CAST((SELECT count(DISTINCT session_id) FROM ended) AS DOUBLE), 6) AS session_outcome_rate
          FROM linked""", f"{LOG}, {ENDED}, {LEDGER.rstrip().rstrip(',')}")  # fmt: skip
def ledger_coverage(spark, sf_dir):
    return D.coverage(*_ledger(spark, sf_dir))


@query("SELECT decision_id, decision FROM log WHERE decision_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_decisions(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("decision_id"))
    return D.unlabelled(decision_log(spark, sf_dir), labels).select("decision_id", "decision")


@query("""SELECT session_id, decision_id, ts, decision FROM log
          QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, decision_id DESC) = 1""")  # fmt: skip
def latest_outcome(spark, sf_dir):
    return D.latest_per_key(decision_log(spark, sf_dir), "session_id", [F.desc("ts"), F.desc("decision_id")]).select("session_id", "decision_id", "ts", "decision")


@query("""SELECT session_id, arg_max(CASE WHEN decision = 'block' THEN 'failed' ELSE 'passed' END, (ts, (decision = 'block')::INT, decision_id)) AS status
          FROM log WHERE decision IN ('check', 'block') GROUP BY session_id""")  # fmt: skip
def final_check(spark, sf_dir):
    return D.final_check(decision_log(spark, sf_dir))


@query("""SELECT c.decision_id AS check_id, (SELECT arg_max(group_id, (g.ts, g.group_id)) FROM (
                 SELECT session_id, file_path, decision_id // 2000 AS group_id, max(ts) AS ts FROM log WHERE decision IN ('allow', 'warn') GROUP BY 1, 2, 3) g
                 WHERE g.session_id = c.session_id AND g.file_path = c.file_path AND g.ts <= c.ts) AS group_id
          FROM log c WHERE decision = 'check'""")  # fmt: skip
def check_to_edit_group(spark, sf_dir):
    log = decision_log(spark, sf_dir)
    edits = log.where("decision in ('allow', 'warn')").withColumn("group_id", F.floor(F.col("decision_id") / 2000))
    return D.check_to_group(edits, log.where("decision = 'check'").withColumnRenamed("decision_id", "check_id"))


@query("""SELECT decision_id, failed_check FROM (SELECT decision_id, decision, last_value(CASE WHEN decision = 'block' THEN decision_id END IGNORE NULLS) OVER (
                 PARTITION BY session_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed_check FROM log)
          WHERE decision IN ('allow', 'warn')""")  # fmt: skip
def last_failed_check(spark, sf_dir):
    return D.last_failed_check(decision_log(spark, sf_dir))


DAILY = "daily AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN decision = 'block' THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM log GROUP BY 1)"
HINKLEY = """cum AS (SELECT day, sum(rate - 0.15 - 0.02) OVER (ORDER BY day) AS cum FROM daily),
    ph AS (SELECT day, cum - least(0.0, min(cum) OVER (ORDER BY day)) AS excess FROM cum)"""


@query("""SELECT CAST(day AS VARCHAR) AS day, round(avg(CAST(would_block AS INTEGER)), 6) AS rate, count(*) AS n FROM (
              SELECT CAST(ts AS DATE) AS day, coalesce(decision = 'shadow_blocked', FALSE) OR decision_id % 6 = 1 AS would_block, CASE decision_id % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'harmful' END AS truth, decision
              FROM audit WHERE decision_id % 3 > 0)
          WHERE CASE WHEN truth IS NOT NULL THEN truth = 'benign' ELSE decision IN ('allowed', 'shadow_blocked') END GROUP BY day""", AUDIT)  # fmt: skip
def daily_false_positives(spark, sf_dir):
    i = F.col("decision_id")
    log = audit_trail(spark, sf_dir).withColumns({
        "shadow": i % 3 > 0, "ground_truth": F.when(i % 4 == 0, "benign").when(i % 4 == 1, "harmful"), "would_block": (F.col("decision") == "shadow_blocked") | (i % 6 == 1)
    })
    return D.daily_false_positives(log).select(F.col("day").cast("string").alias("day"), F.round("rate", 6).alias("rate"), "n")


@query("SELECT CAST(day AS VARCHAR) AS day, round(excess, 6) AS excess, excess > 0.06 AS alarm FROM ph", f"{LOG}, {DAILY}, {HINKLEY}")
def page_hinkley(spark, sf_dir):
    return D.page_hinkley(D.daily_rate(decision_log(spark, sf_dir)), 0.15).select(F.col("day").cast("string").alias("day"), F.round("excess", 6).alias("excess"), "alarm")


@query("SELECT CAST(max(CASE WHEN excess > 0.06 THEN day END) AS VARCHAR) AS day, date_diff('day', max(CASE WHEN excess > 0.06 THEN day END), DATE '2024-01-30') > 14 AS stale FROM ph", f"{LOG}, {DAILY}, {HINKLEY}")
def last_drift_alarm(spark, sf_dir):
    return D.last_alarm(D.page_hinkley(D.daily_rate(decision_log(spark, sf_dir)), 0.15), TODAY).withColumn("day", F.col("day").cast("string"))


@query("""SELECT session_id, CAST(round(max(s - m), 4) AS DOUBLE) AS max_cusum FROM (SELECT session_id, s, min(s) OVER (PARTITION BY session_id ORDER BY decision_id) AS m
          FROM (SELECT session_id, decision_id, sum(latency_ms - 200.0) OVER (PARTITION BY session_id ORDER BY decision_id) AS s FROM log)) GROUP BY 1""")  # fmt: skip
def session_cusum(spark, sf_dir):
    return D.cusum(decision_log(spark, sf_dir), "session_id", "decision_id", "latency_ms", 200.0).withColumn("max_cusum", F.round("max_cusum", 4))


@query("""SELECT count(*) AS score_calls, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 4) AS p99_ms,
                 (SELECT count_if(decision = 'block') FROM log) AS errors FROM (SELECT * FROM log ORDER BY ts DESC, decision_id DESC LIMIT 1000)""")  # fmt: skip
def latency_snapshot(spark, sf_dir):
    """The newest 1,000 are the feature."""
    got = D.latency_snapshot(decision_log(spark, sf_dir).withColumn("error", F.col("decision") == "block"))
    return got.select("score_calls", *[F.round(c, 4).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")], "errors")


@query(f"""SELECT n_repos, n_events, round(days, 6) AS days, n_repos >= 200 AND n_events >= 1000 AND days >= 100 AS promoted,
                 CASE WHEN n_repos >= 200 AND n_events >= 1000 AND days >= 100 THEN 'promotion criteria met' ELSE concat_ws('; ', CASE WHEN n_repos < 200 THEN 'repos ' || n_repos || '/200' END,
                      CASE WHEN n_events < 1000 THEN 'events ' || n_events || '/1000' END, CASE WHEN days < 100 THEN 'days ' || printf('%.1f', days) || '/100.0' END) END AS reason
          FROM (SELECT count(DISTINCT session_id) AS n_repos, count(*) AS n_events, (epoch_us(TIMESTAMP '{TODAY}') - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS days FROM log)""")  # fmt: skip
def promotion_readiness(spark, sf_dir):
    log = decision_log(spark, sf_dir).withColumn("repo", F.col("session_id").cast("string"))
    return D.promotion(log, TODAY, 200, 1000, 100.0).withColumn("days", F.round("days", 6))


@query("""SELECT session_id, file_path, count(DISTINCT coalesce(CAST(batch_id AS VARCHAR), CAST(decision_id AS VARCHAR))) AS failed_attempts
          FROM log WHERE decision = 'block' GROUP BY 1, 2""")  # fmt: skip
def failed_attempts(spark, sf_dir):
    return D.failed_attempts(decision_log(spark, sf_dir), ["session_id", "file_path"])


@query("""SELECT DISTINCT session_id, file_path FROM log WHERE decision = 'allow'
          EXCEPT SELECT session_id, file_path FROM log WHERE decision = 'check' EXCEPT SELECT session_id, file_path FROM log WHERE decision = 'warn'""")  # fmt: skip
def unreviewed_changes(spark, sf_dir):
    files = lambda d: decision_log(spark, sf_dir).where(F.col("decision") == d).select("session_id", "file_path")
    return D.unreviewed(files("allow").distinct(), files("check"), files("warn"), ["session_id", "file_path"])


_ANY = " UNION ALL ".join(
    f"SELECT '{name}' AS category, decision_id, ts FROM lowered WHERE " + " OR ".join([f"s IN ({', '.join(map(repr, sources))})"] * bool(sources) + [f"contains(r, '{x}')" for x in pieces] + [f"d IN ({', '.join(map(repr, decisions))})"] * bool(decisions))
    for name, (sources, pieces, decisions) in D.PAIN.items()
)


@query(f"""SELECT c.category, coalesce(total, 0) AS total, coalesce(today, 0) AS today,
                 CASE WHEN coalesce(total, 0) = 0 THEN 'silent' WHEN total < 3 THEN 'weak' WHEN today = 0 THEN 'warm' ELSE 'active' END AS verdict
          FROM (SELECT unnest({_sql(D.PAIN)}) AS category) c
          LEFT JOIN (SELECT category, count(*) AS total, count_if(CAST(ts AS DATE) = DATE '{TODAY}') AS today FROM ({_ANY}) GROUP BY 1) h ON h.category = c.category""",
       AUDIT + ", lowered AS (SELECT *, lower(coalesce(signal_source, '')) AS s, lower(coalesce(reason, '')) AS r, lower(decision) AS d FROM audit)")
def pain_report(spark, sf_dir):
    return D.pain_report(audit_trail(spark, sf_dir), TODAY)


@query("SELECT file_path, count(*) AS n FROM log GROUP BY file_path ORDER BY n DESC, file_path LIMIT 10")
def busiest_files(spark, sf_dir):
    """A top-10 report."""
    return decision_log(spark, sf_dir).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(10)


@query("""SELECT session_id, count(*) AS n_writes, count_if(NOT ends_with(file_path, '.py')) AS n_other, count(*) >= 5 AND count_if(NOT ends_with(file_path, '.py')) / CAST(count(*) AS DOUBLE) > 0.33 AS warn
          FROM log GROUP BY session_id""")  # fmt: skip
def language_switches(spark, sf_dir):
    return D.language_switches(decision_log(spark, sf_dir), "python")


@query("""SELECT a.decision_id, count(DISTINCT b.decision_id) AS n_later FROM log a JOIN log b ON a.file_path = b.file_path AND a.session_id = b.session_id
                 AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 48 HOUR WHERE a.decision = 'warn' AND b.decision = 'block' GROUP BY a.decision_id""")  # fmt: skip
def later_failures(spark, sf_dir):
    """Warned edits and how many blocks of the same file follow within 48 hours: a range count, no pairs."""
    log = decision_log(spark, sf_dir).withColumn("at", D.micros("ts"))
    from pyspark.sql import Window as W

    w = W.partitionBy("session_id", "file_path").orderBy("at").rangeBetween(1, 48 * 3_600_000_000)
    counted = log.withColumn("n_later", F.coalesce(F.sum((F.col("decision") == "block").cast("long")).over(w), F.lit(0)))
    return counted.where("decision = 'warn' and n_later > 0").select("decision_id", "n_later")
