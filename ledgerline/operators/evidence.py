"""What is known of the decisions in an audit log: labels, checks, outcomes, commits.

events: project_dir, session_id, event_type, decision_id, parent_decision_id, ts
(text), file_path, file_path_rel, decision, tool_name, git_head_before,
git_head_after, outcome_status, verification_status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.commits import linked_commits
from ledgerline.operators.decisions import count_where
from ledgerline.operators.paths import normalised_path

#: Kinds of events that are no decisions, what a decision says, tools that edit
OUTCOME, VERIFICATION, START = "session_outcome_recorded", "verification_recorded", "session_started"
DECISIONS = ("allowed", "allowed_via_override", "blocked", "shadow_blocked", "warn", "fail-open", "override_declined")
EDIT_TOOLS = ("Edit", "Write", "MultiEdit")
LET_THROUGH, STOPPED = ("allowed", "warn", "allowed_via_override"), ("blocked", "shadow_blocked")
STATUSES = ("verified_clean", "unverified_gap", "unverified_infrastructure")


def is_decision(event_type: Column, file_path: Column, decision: Column, tool_name: Column) -> Column:
    """An event about a file that says one of DECISIONS or comes from an edit; nulls say nothing."""
    told = F.coalesce(decision.isin(*DECISIONS), F.lit(False)) | F.coalesce(tool_name.isin(*EDIT_TOOLS), F.lit(False))
    other = F.coalesce(event_type.isin(OUTCOME, VERIFICATION, START), F.lit(False))
    return ~other & (F.coalesce(file_path, F.lit("")) != "") & told


def keyed(events: DataFrame) -> DataFrame:
    """With project and session, empty where an event has none, and whether it is a decision."""
    given = F.coalesce("project_dir", F.lit(""))
    project = F.when(given == "", "").otherwise(normalised_path(given))
    flag = is_decision(F.col("event_type"), F.col("file_path"), F.col("decision"), F.col("tool_name"))
    return events.withColumns({"project": project, "session": F.coalesce("session_id", F.lit("")), "is_decision": flag})


def session_rollup(events: DataFrame) -> DataFrame:
    """project, session, and how many decisions, checks and outcomes it has. A
    session's name counts within its project only."""
    of = lambda kind: count_where(F.coalesce(F.col("event_type") == kind, F.lit(False)))
    return keyed(events).groupBy("project", "session").agg(count_where(F.col("is_decision")).alias("decision_count"), of(VERIFICATION).alias("verification_count"), of(OUTCOME).alias("outcome_count"))


def evidence_ledger(events: DataFrame, labels: DataFrame, commits: DataFrame) -> DataFrame:
    """A row a decision: its labels, the checks of its session that name it (and
    how many failed and passed), its session's latest outcome (by the text of its
    time), and the commits between its head and that outcome's that touch its
    file; and a grade: strong with a check or a commit, partial with a label or
    an outcome only, else unlinked.

    labels: decision_id, one row a label; commits: as linked_commits takes them,
    by project. Rows without an id are linked with nothing.
    """
    from ledgerline.plans.scratch import written as cut

    rows = keyed(events)
    key = ["project", "session"]
    checks = rows.where(F.col("event_type") == VERIFICATION).groupBy(*key, F.col("parent_decision_id").alias("decision_id")).agg(
        F.count(F.lit(1)).alias("n_checks"), count_where(F.col("verification_status") == "failed").alias("n_failed"), count_where(F.col("verification_status") == "passed").alias("n_passed")
    )
    newest = F.max_by(F.struct("outcome_status", "git_head_after"), F.struct(F.coalesce("ts", F.lit("")), "decision_id")).alias("o")
    outcomes = rows.where(F.col("event_type") == OUTCOME).groupBy(*key).agg(newest).select(*key, F.lit(True).alias("ended"), F.col("o.outcome_status").alias("outcome"), F.col("o.git_head_after").alias("git_head_after"))
    per_label = labels.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n_labels"))
    made = rows.where("is_decision").select("decision_id", *key, "ts", "file_path", "file_path_rel", "decision", "git_head_before")
    made = cut(made.join(outcomes, key, "left"))
    per_commit = linked_commits(made, commits).groupBy("decision_id").agg(F.count(F.lit(1)).alias("n_commits"))
    joined = made.join(per_label, "decision_id", "left").join(per_commit, "decision_id", "left").join(checks, [*key, "decision_id"], "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_labels", "n_checks", "n_failed", "n_passed", "n_commits")}
    joined = joined.withColumns(counts | {"ended": F.coalesce("ended", F.lit(False))})
    grade = F.when((F.col("n_checks") > 0) | (F.col("n_commits") > 0), "strong").when((F.col("n_labels") > 0) | F.col("ended"), "partial").otherwise("unlinked")
    return joined.select("decision_id", *key, "ts", "file_path", "decision", *counts, "ended", "outcome", grade.alias("grade"))


def evidence_summary(ledger: DataFrame) -> DataFrame:
    """One row: decisions, and of them those with a label, a check, a commit;
    those let through whose check failed, and stopped whose check passed."""
    d = F.col("decision")
    return ledger.agg(
        F.count(F.lit(1)).alias("decisions"), count_where(F.col("n_labels") > 0).alias("labelled"), count_where(F.col("n_checks") > 0).alias("exact_links"), count_where(F.col("n_commits") > 0).alias("commit_links"),
        count_where(d.isin(*LET_THROUGH) & (F.col("n_failed") > 0)).alias("failed_links"), count_where(d.isin(*STOPPED) & (F.col("n_passed") > 0)).alias("blocked_pass_links"),
    )
