"""Sources and sinks: decision logs, labels, results, source trees, commits."""

from __future__ import annotations

import gzip
import json
import os
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Schema version, retention in days and cap in bytes of the log folder
SCHEMA_VERSION, KEEP_DAYS, CAP_BYTES = 4, 90, 5 << 30

DECISIONS = (
    "event_type string, decision_id string, session_id string, project_dir string, ts string, file_path string, file_path_rel string, decision string, "
    "tool_name string, signal_source string, reason string, gate_id string, latency_ms bigint, retry_after_block boolean, task_id string, run_id string, "
    "git_head_before string, risk_vector array<double>, host string, schema_version int, parent_decision_id string, check_batch_id string, "
    "verification_kind string, verification_status string, outcome_status string, checksum string, _corrupt string"
)
LABELS = "decision_id string, session_id string, file_path string, decision string, labels map<string,boolean>, notes string, labeler_id string, ts string"
RESULTS = (
    "task_id string, arm string, repo string, resolved boolean, regression_introduced boolean, newly_failing_tests array<string>, "
    "tokens_in bigint, tokens_out bigint, wall_clock_s double, timeout boolean"
)


def day_folders(today: date, days: int) -> list[str]:
    """Today and the days - 1 before it."""
    return [(today - timedelta(days=k)).isoformat() for k in range(days)]


def read_log(spark: SparkSession, root: str, today: date | None = None, days: int | None = None) -> DataFrame:
    """<root>/<YYYY-MM-DD>/<session>.jsonl or .jsonl.gz, of all days or the last
    `days`; `day` is the folder. Lines that aren't JSON are in `_corrupt`;
    nothing else is dropped. The wanted folders alone are listed."""
    pattern = "*" if days is None else "{" + ",".join(day_folders(today or date.today(), days)) + "}"
    lines = spark.read.text(f"{root}/{pattern}/*.jsonl*").select("value", F.regexp_extract("_metadata.file_path", r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1).cast("date").alias("day"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.select(F.from_json("value", DECISIONS, options).alias("row"), "day").select("row.*", "day")


def find_decision(log: DataFrame, decision_id: str) -> DataFrame:
    """The newest row of that id."""
    return log.where(F.col("decision_id") == decision_id).orderBy(F.desc("day"), F.desc("ts")).limit(1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """decision_id and all of its labels in an array."""
    rows = spark.read.schema(LABELS).json(path).where("decision_id is not null")
    return rows.groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("ts", "labeler_id", "notes"))).alias("entries"), F.collect_list("labels").alias("labels"))


def label_counts(spark: SparkSession, path: str, target: int) -> DataFrame:
    """Positives per label, and how many are still wanted."""
    each = spark.read.schema(LABELS).json(path).select(F.explode("labels").alias("label", "value")).where("value")
    n = F.count(F.lit(1))
    return each.groupBy("label").agg(n.alias("n"), F.greatest(F.lit(0), target - n).alias("missing"))


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """One JSON file per task and arm; reports are skipped; of several files the last by name stays."""
    rows = spark.read.schema(RESULTS).option("multiLine", True).json(root).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.where(~F.col("file").rlike(r"/(?:report|run_summary)\.json$") & F.col("task_id").isNotNull() & F.col("arm").isNotNull())
    w = W.partitionBy("task_id", "arm").orderBy(F.desc("file"))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


#: Folders of a source tree that are never read
SKIPPED = r"/(?:\.[^/]+|node_modules|__pycache__|[^/]*\.egg-info|dist|build|venv)/"


def read_tree(spark: SparkSession, root: str, endings: list[str]) -> DataFrame:
    """path (relative) and text of a source tree's files."""
    glob = "*.{" + ",".join(endings) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = os.path.basename(root.rstrip("/"))
    relative = F.regexp_extract("path", rf".*?/{base}/(.*)$", 1)
    return files.where(~F.concat(F.lit("/"), relative).rlike(SKIPPED)).select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def scan_tests(tree: DataFrame) -> DataFrame:
    from ledgerline.operators.rules import is_test

    return tree.where(is_test(F.col("path")))


def append_log(rows: DataFrame, root: str, scrub=None) -> None:
    """Append rows as JSON lines in folders of their day (column day), after `scrub`."""
    (scrub(rows) if scrub else rows).write.mode("append").partitionBy("day").json(root)


def upgrade(rows: DataFrame, host: str = "unknown") -> DataFrame:
    """Old rows get the host and the current version where they have none."""
    return rows.withColumns({"host": F.coalesce("host", F.lit(host)), "schema_version": F.coalesce("schema_version", F.lit(SCHEMA_VERSION))})


def retained(files: DataFrame, today: str, days: int = KEEP_DAYS, cap: int = CAP_BYTES) -> DataFrame:
    """path, modified (date), size, keep: young enough and, from the newest, within the cap."""
    young = F.datediff(F.lit(today).cast("date"), "modified") <= days
    so_far = F.sum("size").over(W.partitionBy(young).orderBy(F.desc("modified"), "path").rowsBetween(W.unboundedPreceding, 0))
    return files.withColumn("keep", young & (so_far <= cap))


def write_session(root: str, day: str, session: str, rows: list[dict], packed: bool = False) -> str:
    """A session's file, for tests and for importing logs of other tools."""
    os.makedirs(f"{root}/{day}", exist_ok=True)
    path = f"{root}/{day}/{session}.jsonl" + ".gz" * packed
    opener = gzip.open if packed else open
    with opener(path, "at", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    return path


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """sha, author, date, subject, files of a text export of
    `git log --name-only --pretty=format:"%x1e%H%x1f%an%x1f%aI%x1f%s"`, on any file
    system; Spark splits it at the record mark. Records without a hash are left out."""
    records = spark.read.option("lineSep", "\x1e").text(path).select(F.split("value", r"\r?\n").alias("lines"))
    head = F.split(F.element_at("lines", 1), "\x1f")
    part = lambda i: F.coalesce(F.get(head, F.lit(i)), F.lit(""))
    files = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.trim(x) != "")
    return records.select(part(0).alias("sha"), part(1).alias("author"), part(2).alias("date"), part(3).alias("subject"), files.alias("files")).where("sha <> ''")


#: what an export for read_history has to be made with
HISTORY_FORMAT = "%x1e%H%x1f%P%x1f%ct%x1f%an%x1f%s"


def read_history(spark: SparkSession, path: str, project: str) -> DataFrame:
    """project, sha, parents (first one first), ts (seconds), author, message,
    files of a text export of `git log --all --name-only --pretty=format:` with
    HISTORY_FORMAT; a merge has no files, as in the log. Records without a hash are left out."""
    records = spark.read.option("lineSep", "\x1e").text(path).select(F.split("value", r"\r?\n").alias("lines"))
    part = lambda i: F.coalesce(F.get(F.split(F.element_at("lines", 1), "\x1f"), F.lit(i)), F.lit(""))
    words = lambda x: F.filter(x, lambda w: F.trim(w) != "")
    files = words(F.slice("lines", F.lit(2), F.size("lines")))
    rows = records.select(F.lit(project).alias("project"), part(0).alias("sha"), words(F.split(part(1), " ")).alias("parents"), part(2).try_cast("long").alias("ts"), part(3).alias("author"), part(4).alias("message"), files.alias("files"))
    return rows.where("sha <> ''")
