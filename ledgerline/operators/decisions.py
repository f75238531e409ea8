"""Operators over a decision log.

Columns that they use: decision_id, session_id, ts, file_path, decision,
signal_source, latency_ms, checksum. A log may have more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCKING = ("block", "deny")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, of a timestamp with or without zone (then UTC's session)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))



RETRY_SECONDS = 120

#: Weights of the efficiency score and of the token cost
EFFICIENCY_SCALE, ACTION_COST = 0.43, 1.5
#: Reasons and decisions by which events are classed
DRIFT_REASON, AWAY_REASON = "plan_impl_drift", "sidecar_unavailable"
CAUGHT = ("blocked", "warn", "shadow_blocked")
OVERRIDES = ("operator_override", "allowed_via_override")
SELF_PROTECTION = ("shell_escape", "guard_file_locked", "language_fingerprint_violation")
#: Pain categories, with their sources, pieces of reasons, decisions
PAIN = {
    "1_scope_creep": (("plan_grounding",), ("plan_grounding", "off_plan", "not_in_plan"), ()),
    "2_pattern_blindness": (("novelty", "session_centroid_drift", "project_fan_in", "project_coupling"), ("novelty", "centroid_drift", "fan_in", "coupling"), ()),
    "3_spec_drift": (("plan_quality", "decomposition_recipe"), ("cgs_below", "plan_quality", "decomp", "framework_pivot", "boundary_prose"), ()),
    "4_token_waste": (("hard_cap", "bm25_fallback"), ("hard_cap_exceeded", "timeout", "gen_timeout"), ()),
    "5_local_only_violations": (("network_exfil",), ("non_loopback", "external_nic"), ()),
    "6_hallucinated_apis": (("validate_imports", "rule_engine_import", "forbid_import"), ("unknown_module", "unknown_symbol", "forbid_import"), ()),
    "7_runtime_enforcement": ((), (), ("blocked", "exit_block", "exit_blocked")),
    "8_over_engineering": (("plan_loc", "phase_ratio"), ("loc_block", "loc_budget", "phase_to_file_ratio", "per_file_loc"), ()),
    "9_repo_conventions": (("lang_lock", "rule_engine_pattern", "forbid_pattern"), ("lang_lock", "forbid_pattern", "language_mismatch"), ()),
}
#: Drift allowance, alarm level and days until an alarm is stale
DRIFT_SLACK, DRIFT_ALARM, STALE_DAYS = 0.02, 0.06, 14


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def severity(reason: Column, decision: Column, gate: Column) -> Column:
    """Class of an event by its decision, reason and gate; the first that holds. Nulls match nothing."""
    r, d = F.lower(F.coalesce(reason, F.lit(""))), F.lower(F.coalesce(decision, F.lit("")))
    gate = F.coalesce(gate, F.lit(""))
    return (
        F.when(d == "fail-open", "fail_open")
        .when(d == "shadow_blocked", "shadow")
        .when(d.isin(*OVERRIDES), "override")
        .when(r.contains("contract_violation"), "contract")
        .when(r.contains("oracle"), "oracle")
        .when(r.startswith("rule_engine:"), "rule_engine")
        .when(r == DRIFT_REASON, "plan_grounding")
        .when(r.isin(*SELF_PROTECTION) | r.startswith("kill_switch") | r.startswith("magic_comment"), "self_protection")
        .when((gate == "plan_grounding") | r.contains("plan"), "plan_grounding")
        .when(gate == "rules", "rule_engine")
        .otherwise("other")
    )


def pain_categories(source: Column, reason: Column, decision: Column) -> Column:
    """All categories that hold, in their order: the event's source, a piece of its reason or its decision is one of theirs."""
    s, r, d = (F.lower(F.coalesce(x, F.lit(""))) for x in (source, reason, decision))
    found = []
    for name, (sources, pieces, decisions) in PAIN.items():
        tests = [s.isin(*sources)] * bool(sources) + [r.contains(x) for x in pieces] + [d.isin(*decisions)] * bool(decisions)
        any_ = tests[0]
        for t in tests[1:]:
            any_ = any_ | t
        found.append(F.when(any_, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def in_window(df: DataFrame, after: str | None, before: str | None) -> DataFrame:
    """Days from `after` on and before `before`; rows without a time go only where there is a bound."""
    day = F.date_format("ts", "yyyy-MM-dd")
    if after is not None:
        df = df.where(day >= after)
    if before is not None:
        df = df.where(day < before)
    return df


def with_retry(log: DataFrame, seconds: int = RETRY_SECONDS) -> DataFrame:
    """retry_after_block: the file's last block is at most `seconds` ago (that second included)."""
    before = W.partitionBy("session_id", "file_path").orderBy("ts", "decision_id").rowsBetween(W.unboundedPreceding, -1)
    blocked_at = F.last(F.when(F.col("decision").isin(*BLOCKING), F.col("ts")), ignorenulls=True).over(before)
    gap = micros("ts") - micros(blocked_at)
    return log.withColumn("retry_after_block", F.coalesce(gap <= seconds * 1_000_000, F.lit(False)))


def benchmark(log: DataFrame, by: list[str]) -> DataFrame:
    """Counts of decisions, scope creep (drift and contract violations), latencies,
    the token cost and the false-positive proxy, per group or over all.

    log: decision, reason, retry_after_block, latency_ms. The proxy is retried
    blocks and allowed overrides over what was blocked, also in shadow; null if
    nothing was. Latencies are cut to whole milliseconds; null without any.
    """
    d, latency = F.coalesce("decision", F.lit("unknown")), F.col("latency_ms")
    reason = F.coalesce("reason", F.lit(""))
    of = lambda name: count_where(d == name)
    creep = (reason == DRIFT_REASON) | F.lower(reason).contains("contract_violation")
    stopped = d.isin("blocked", "shadow_blocked")
    retried = count_where((d == "blocked") & F.coalesce("retry_after_block", F.lit(False)))
    whole = lambda x: F.floor(x).cast("long")
    n, blocked, shadow, overridden = F.count(F.lit(1)), of("blocked"), of("shadow_blocked"), of("allowed_via_override")
    grouped = log.groupBy(*by) if by else log
    return grouped.agg(
        n.alias("n_events"), blocked.alias("blocked"), of("warn").alias("warn"), shadow.alias("shadow_blocked"), of("fail-open").alias("fail_open"), of("allowed").alias("allowed"),
        overridden.alias("allowed_via_override"), of("operator_override").alias("operator_override"), of("operator_confirmed").alias("operator_confirmed"), retried.alias("retried"),
        count_where(creep).alias("scope_creep"), count_where(creep & stopped).alias("scope_creep_blocked"), count_where(creep & ~stopped).alias("scope_creep_warned"),
        whole(F.percentile(latency, 0.5)).alias("median_ms"), whole(F.percentile(latency, 0.95)).alias("p95_ms"), whole(F.percentile(F.when(d == "blocked", latency), 0.5)).alias("median_block_ms"),
        F.round(n * 1.0 + ACTION_COST * (blocked + of("warn") + shadow + overridden), 1).alias("token_cost"),
        F.least(F.lit(1.0), F.round(F.try_divide(retried + overridden, F.nullif(blocked + shadow, F.lit(0))), 3)).alias("false_positive_proxy"),
    )


def severity_counts(log: DataFrame) -> DataFrame:
    """How many events of each class; allowed ones aren't counted."""
    classed = log.where(F.coalesce("decision", F.lit("unknown")) != "allowed").select(severity(F.col("reason"), F.col("decision"), F.col("gate_id")).alias("severity"))
    return classed.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def daily_false_positives(log: DataFrame) -> DataFrame:
    """day, rate, n: of a day's shadow rows that are benign how many would have
    been blocked. Benign is what ground_truth says; where it says nothing, a row
    that was allowed or blocked in shadow only. log: ts, shadow, ground_truth,
    decision, would_block; nulls count as no."""
    benign = F.when(F.col("ground_truth").isNotNull(), F.col("ground_truth") == "benign").otherwise(F.coalesce(F.col("decision").isin("allowed", "shadow_blocked"), F.lit(False)))
    rows = log.where(F.coalesce("shadow", F.lit(False)) & benign & F.col("ts").isNotNull())
    flag = F.coalesce("would_block", F.lit(False)).cast("double")
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.avg(flag).alias("rate"), F.count(F.lit(1)).alias("n"))


def latency_snapshot(log: DataFrame, newest: int = 1000) -> DataFrame:
    """One row: calls and percentiles of the newest latencies, and all errors. log: ts, decision_id, latency_ms, error."""
    last = log.where("latency_ms is not null").orderBy(F.desc("ts"), F.desc("decision_id")).limit(newest)
    p = lambda q: F.coalesce(F.percentile("latency_ms", q), F.lit(0.0))
    calls = last.agg(F.count(F.lit(1)).alias("score_calls"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"))
    return calls.crossJoin(log.agg(count_where(F.coalesce("error", F.lit(False))).alias("errors")))  # a row each


def efficiency(log: DataFrame, overrides: DataFrame) -> DataFrame:
    """Drift that the plan gate caught, less what was false, per second of
    latency, scaled by how often the scorer was there. One row; none for an
    empty log.

    Caught: reason plan_impl_drift, blocked, warned or blocked in shadow. False:
    of these, a block that was retried at once, or whose decision was overridden
    later (overrides: file_path, decision_id). log: decision_id, file_path,
    decision, reason, retry_after_block, latency_ms.
    """
    links = overrides.select("file_path", "decision_id").distinct().withColumn("__linked", F.lit(True))
    log = log.join(links, ["file_path", "decision_id"], "left")
    reason, d = F.coalesce("reason", F.lit("")), F.col("decision")
    caught = (reason == DRIFT_REASON) & d.isin(*CAUGHT)
    retried = F.coalesce("retry_after_block", F.lit(False)) & (d == "blocked")
    false = caught & (retried | F.coalesce("__linked", F.lit(False)))
    n, away = F.count(F.lit(1)), count_where(reason.startswith(AWAY_REASON))
    seconds = F.coalesce(F.sum("latency_ms"), F.lit(0)) / 1000.0
    gain = F.greatest(F.lit(0), count_where(caught) - count_where(false)) / (seconds + 1) * EFFICIENCY_SCALE
    score = gain * F.greatest(F.lit(0.0), 1 - away / F.greatest(n, F.lit(1)))
    out = log.agg(n.alias("n_events"), count_where(caught).alias("caught"), count_where(false).alias("false_drifts"), F.round(score, 8).alias("score"))
    return out.where("n_events > 0")


def override_survival(log: DataFrame, current: DataFrame) -> DataFrame:
    """One row: of the edits that an override let through, how many files still
    are as they were then, how many aren't, and of how many it isn't known, with
    the shares of the first two (4 decimals); none of them gives shares of 0.

    log: decision, file_path, digest (of the file's content then), rows without
    a file are left out; current: file_path, digest, one row a file that is there.
    """
    past = log.where((F.col("decision") == "allowed_via_override") & F.col("file_path").isNotNull()).select("file_path", F.col("digest").alias("__then"))
    joined = past.join(current.select("file_path", F.col("digest").alias("__now")), "file_path", "left")
    same, n = F.col("__then") == F.col("__now"), F.count(F.lit(1))
    survived, reverted = count_where(F.coalesce(same, F.lit(False))), count_where(F.coalesce(~same, F.lit(False)))
    share = lambda x: F.round(x / F.greatest(n, F.lit(1)), 4)
    return joined.agg(
        n.alias("overrides"), survived.alias("survived"), reverted.alias("reverted"), (n - survived - reverted).alias("unknown"),
        share(survived).alias("survival_ratio"), share(reverted).alias("reverted_ratio"),
    )


def session_rollup(log: DataFrame) -> DataFrame:
    """Per session its decisions, checks and outcomes, what was blocked and warned, files, and times."""
    d = F.col("decision")
    return log.groupBy("session_id").agg(
        count_where(~d.isin("check", "end")).alias("decisions"),
        count_where(d == "check").alias("verifications"),
        count_where(d == "end").alias("outcomes"),
        count_where(d.isin(*BLOCKING)).alias("blocked"),
        count_where(d == "warn").alias("warned"),
        F.countDistinct("file_path").alias("n_files"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def ledger(log: DataFrame, labels: DataFrame, commits: DataFrame) -> DataFrame:
    """Each edit with its labels, the checks that name it, its session's outcome
    and the commits that hold it; a grade of that evidence: strong with a check or
    a commit, partial with a label or an outcome only, else unlinked.

    labels: decision_id, one row a label; commits: decision_id, one row a linked
    commit. checks: log rows of decision 'check', linked to the edit of that session
    whose id is parent_id. Outcome: the session's latest 'end' row.
    """
    per_label = labels.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n_labels"))
    per_commit = commits.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n_commits"))
    checks = log.where("decision = 'check'").groupBy("session_id", F.col("parent_id").alias("decision_id")).agg(F.count(F.lit(1)).alias("n_checks"))
    ends = log.where("decision = 'end'").groupBy("session_id").agg(F.max_by("checksum", F.struct("ts", "decision_id")).alias("outcome"))
    edits = log.where("decision not in ('check', 'end')")
    joined = edits.join(per_label, "decision_id", "left").join(per_commit, "decision_id", "left").join(checks, ["session_id", "decision_id"], "left").join(ends, "session_id", "left")
    has = lambda c: F.col(c).isNotNull()
    grade = F.when(has("n_checks") | has("n_commits"), "strong").when(has("n_labels") | has("outcome"), "partial").otherwise("unlinked")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_labels", "n_checks", "n_commits")]
    return joined.select("decision_id", "session_id", *counts, "outcome", grade.alias("grade"))


def coverage(linked: DataFrame, log: DataFrame) -> DataFrame:
    """One row: sessions and edits, and which share of them (6 decimals, null of
    none) has a label, a check, a commit; of the sessions, an outcome."""
    rate = lambda n, of: F.round(F.try_divide(n, F.nullif(of, F.lit(0))), 6)
    n = F.count(F.lit(1))
    edits = linked.agg(n.alias("decisions"), *[rate(count_where(F.col(c) > 0), n).alias(k) for c, k in (("n_labels", "label_rate"), ("n_checks", "exact_verification_rate"), ("n_commits", "commit_link_rate"))])
    ended = F.countDistinct(F.when(F.col("decision") == "end", F.col("session_id")))
    sessions = F.countDistinct("session_id")
    return edits.crossJoin(log.agg(sessions.alias("sessions"), rate(ended, sessions).alias("session_outcome_rate")))  # a row each


def unlabelled(log: DataFrame, labels: DataFrame) -> DataFrame:
    return log.join(labels, "decision_id", "left_anti")


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key that comes last."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def newest(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The newest n rows of each key (bounded history)."""
    w = W.partitionBy(*by).orderBy(F.desc("ts"), F.desc("decision_id"))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def check_to_group(edits: DataFrame, checks: DataFrame) -> DataFrame:
    """Each check with the latest edit group of its file whose *last* edit isn't
    after it; a group that is still being edited doesn't get the check.

    edits: session_id, file_path, group_id, ts; checks: check_id, session_id, file_path, ts.
    One sort of both by file and time, no pairs of checks and groups.
    """
    ends = edits.groupBy("session_id", "file_path", "group_id").agg(F.max("ts").alias("ts"))
    none = F.lit(None).cast("long")
    rows = ends.select("session_id", "file_path", "ts", F.lit(0).alias("side"), F.col("group_id"), none.alias("check_id")).unionByName(
        checks.select("session_id", "file_path", "ts", F.lit(1).alias("side"), none.alias("group_id"), "check_id")
    )
    w = W.partitionBy("session_id", "file_path").orderBy("ts", "side", "group_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("group_id", F.last("group_id", ignorenulls=True).over(w)).where("side = 1").select("check_id", "group_id")


def last_failed_check(log: DataFrame) -> DataFrame:
    """For each edit the last failed check of its session strictly before it."""
    timed = log.withColumn("ts", micros("ts"))
    w = W.partitionBy("session_id").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    failed = F.last(F.when(F.col("decision") == "block", F.col("decision_id")), ignorenulls=True).over(w)
    return timed.withColumn("failed_check", failed).where("decision in ('allow', 'warn')").select("decision_id", "failed_check")


def final_check(log: DataFrame) -> DataFrame:
    """Per session the last check's status; of equal times a failed one wins, then the greater id."""
    is_check = F.col("decision").isin("check", "block")
    order = F.struct("ts", (F.col("decision") == "block").cast("int").alias("failed"), "decision_id")
    return log.where(is_check).groupBy("session_id").agg(F.max_by(F.when(F.col("decision") == "block", "failed").otherwise("passed"), order).alias("status"))


def daily_rate(log: DataFrame) -> DataFrame:
    """Share of blocked rows per UTC day."""
    return log.groupBy(F.to_date("ts").alias("day")).agg(
        F.avg(F.col("decision").isin(*BLOCKING).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")
    )


def page_hinkley(rates: DataFrame, target: float) -> DataFrame:
    """The cumulated excess of a daily rate over its running minimum, floored at
    zero, and whether that is an alarm. One row a day, so one window over all days."""
    w = W.partitionBy(F.lit(1)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    cum = rates.withColumn("cum", F.sum(F.col("rate") - target - DRIFT_SLACK).over(w))
    excess = F.col("cum") - F.least(F.lit(0.0), F.min("cum").over(w))
    return cum.withColumn("excess", excess).withColumn("alarm", F.col("excess") > DRIFT_ALARM)


def last_alarm(alarms: DataFrame, today: str) -> DataFrame:
    last = F.max(F.when(F.col("alarm"), F.col("day")))
    return alarms.agg(last.alias("day"), (F.datediff(F.lit(today).cast("date"), last) > STALE_DAYS).alias("stale"))


def cusum(df: DataFrame, key: str, order: str, value: str, slack: float) -> DataFrame:
    """Per key the greatest S - running min(S), the minimum taking in the current sum (no floor at zero)."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    s = df.withColumn("__s", F.sum(F.col(value) - slack).over(w))
    return s.withColumn("__e", F.col("__s") - F.min("__s").over(w)).groupBy(key).agg(F.max("__e").alias("max_cusum"))


def promotion(log: DataFrame, now: str, repos: int = 5, events: int = 1000, days: float = 14.0) -> DataFrame:
    """One row: distinct repositories, events, days since the first, whether that
    is enough, and what isn't. log: repo, ts. An empty log isn't promoted."""
    age = F.coalesce((micros(F.lit(now)) - micros(F.min("ts"))) / 86_400_000_000.0, F.lit(0.0))
    one = log.agg(F.countDistinct(F.coalesce("repo", F.lit(""))).alias("n_repos"), F.count(F.lit(1)).alias("n_events"), age.alias("days"))
    short = [
        F.when(F.col("n_repos") < repos, F.format_string(f"repos %d/{repos}", "n_repos")),
        F.when(F.col("n_events") < events, F.format_string(f"events %d/{events}", "n_events")),
        F.when(F.col("days") < days, F.format_string(f"days %.1f/{days}", "days")),
    ]
    why = F.concat_ws("; ", *short)
    reason = F.when(F.col("n_events") == 0, "no shadow events recorded").when(why == "", "promotion criteria met").otherwise(why)
    return one.withColumn("promoted", (F.col("n_events") > 0) & (why == "")).withColumn("reason", reason)


def failed_attempts(log: DataFrame, by: list[str]) -> DataFrame:
    """Distinct batches of failed checks; without a batch each check is its own."""
    batch = F.coalesce(F.col("batch_id").cast("string"), F.col("decision_id").cast("string"), F.lit(""))
    return log.where(F.col("decision").isin(*BLOCKING)).groupBy(*by).agg(F.countDistinct(batch).alias("failed_attempts"))


def unreviewed(changed: DataFrame, gated: DataFrame, acknowledged: DataFrame, on: list[str]) -> DataFrame:
    """Changed and neither gated nor acknowledged."""
    return changed.join(gated, on, "left_anti").join(acknowledged, on, "left_anti")


def pain_report(log: DataFrame, today: str) -> DataFrame:
    """Per category its total, today's, and a verdict; categories that never occur too."""
    cats = pain_categories(F.col("signal_source"), F.col("reason"), F.col("decision"))
    hits = log.select(F.explode(cats).alias("category"), F.to_date("ts").alias("day"))
    counted = hits.groupBy("category").agg(F.count(F.lit(1)).alias("total"), count_where(F.col("day") == F.lit(today).cast("date")).alias("today"))
    names = log.sparkSession.createDataFrame([(x,) for x in PAIN], "category string")
    total, day = F.coalesce("total", F.lit(0)), F.coalesce("today", F.lit(0))
    verdict = F.when(total == 0, "silent").when(total < 3, "weak").when(day == 0, "warm").otherwise("active")
    return names.join(counted, "category", "left").select("category", total.alias("total"), day.alias("today"), verdict.alias("verdict"))


def language_switches(log: DataFrame, declared: str, least: int = 5, share: float = 0.33) -> DataFrame:
    """Per session its writes to files of a known language, how many of another
    one than declared, and a warning above `share` of `least` writes or more."""
    from ledgerline.operators.rules import language

    rows = log.select("session_id", language(F.col("file_path")).alias("language")).where("language is not null")
    n, other = F.count(F.lit(1)), count_where(F.col("language") != declared)
    return rows.groupBy("session_id").agg(n.alias("n_writes"), other.alias("n_other"), ((n >= least) & (other / n > share)).alias("warn"))
