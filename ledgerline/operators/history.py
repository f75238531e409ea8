"""Operators over commits, snapshots and judged outcomes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Hours in which a follow-up counts, share of files of a family that is a home language, its least count
FOLLOW_UP_HOURS, FAMILY_SHARE = 48, 0.10
#: touches of files that one task puts in order
TOUCHES = 500_000
#: Judge scores that are good and bad
GOOD, BAD = 4, 2


def followed_up(touches: DataFrame, hours: int = FOLLOW_UP_HOURS) -> DataFrame:
    """sha of commits one of whose files another commit touches within `hours`
    after, and how many such files. touches: sha, file, ts.

    The next touch of a file decides. Times are cut into pieces of `hours`: the
    next touch that counts is in a row's own piece or is the first of the next
    one, so that a file that is touched all the time isn't one task. Tasks grow in
    number with the touches, TOUCHES of them each."""
    from ledgerline.plans.scratch import written

    micros, span = F.unix_micros(F.col("ts").cast("timestamp")), hours * 3_600_000_000
    rows = written(touches.select("sha", "file", micros.alias("__at"), F.floor(micros / span).alias("__piece")))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TOUCHES))
    after = W.partitionBy("file", "__piece").orderBy("__at").rangeBetween(1, W.unboundedFollowing)
    firsts = rows.groupBy("file", (F.col("__piece") - 1).alias("__piece")).agg(F.min("__at").alias("__first"))
    placed = rows.repartition(n, "file", "__piece").withColumn("__next", F.min("__at").over(after)).join(firsts, ["file", "__piece"], "left")
    later = F.coalesce("__next", "__first") - F.col("__at") <= span
    return placed.where(later).groupBy("sha").agg(F.countDistinct("file").alias("n_files"))


def follow_pairs(commits: DataFrame, kind: str) -> DataFrame:
    """Commits of a kind with the commit that they name (target), and the files that both touch.
    commits: sha, kind, target, files."""
    target = commits.select(F.col("sha").alias("target"), F.col("files").alias("__files"))
    joined = commits.where(F.col("kind") == kind).join(target, "target")
    return joined.select("sha", "target", F.array_sort(F.array_intersect("files", "__files")).alias("shared"))


def language_families(files: DataFrame, family: str) -> DataFrame:
    """Files per family and whether they are int(10 %) of all or more."""
    n = F.count(F.lit(1))
    counts = files.groupBy(family).agg(n.alias("n"))
    every = F.floor(F.sum("n").over(W.partitionBy(F.lit(1))) * FAMILY_SHARE)
    return counts.select(family, "n", (F.col("n") >= F.greatest(F.lit(1), every)).alias("home"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two snapshots (path, digest)."""
    b, a = before.select("path", F.col("digest").alias("b")), after.select("path", F.col("digest").alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "path", "full").select("path", kind.alias("change")).where("change is not null")


def first_seen(violations: DataFrame) -> DataFrame:
    """The first row of each (kind, path)."""
    return violations.groupBy("kind", "path").agg(F.min("ts").alias("first_ts"), F.min_by("id", F.struct("ts", "id")).alias("id"))


def judged_outcome(scores: DataFrame, key: str, score: str) -> DataFrame:
    """resolved and regressed, each 0 or 1: where more judges score high than low,
    or fewer; of equals the mean decides, if it is as high or as low as a score
    has to be. Null scores aren't counted; a key without any is neither."""
    good, bad = F.count(F.when(F.col(score) >= GOOD, 1)), F.count(F.when(F.col(score) <= BAD, 1))
    mean = F.avg(score)
    flag = lambda ahead, behind, level: F.when(ahead > behind, 1).when(behind > ahead, 0).otherwise(F.coalesce(level.cast("int"), F.lit(0)))
    return scores.groupBy(key).agg(
        good.alias("n_high"), bad.alias("n_low"), flag(good, bad, mean >= GOOD).alias("resolved"), flag(bad, good, mean <= BAD).alias("regressed")
    )


def file_claims(claims: DataFrame, hunks: DataFrame) -> DataFrame:
    """Each claim with the first hunk of its commit whose file's stem it names, else the hunk at its place modulo their number.

    claims: sha, claim_no, claim; hunks: sha, hunk_no (from 0), stem.
    """
    sizes = hunks.groupBy("sha").agg(F.count(F.lit(1)).alias("__n"))
    named = claims.join(hunks, "sha").where("instr(lower(claim), lower(stem)) > 0")
    best = named.groupBy("sha", "claim_no").agg(F.min("hunk_no").alias("__named"))
    joined = claims.join(sizes, "sha").join(best, ["sha", "claim_no"], "left")
    return joined.select("sha", "claim_no", F.coalesce("__named", F.col("claim_no") % F.col("__n")).alias("hunk_no"))


def _needed(kept: list, row: tuple) -> bool:
    """Whether some (sha, file) clashes with all of `kept` but not with `row`; rows are (id, sha, file)."""
    if not kept:
        return True
    _, sha, file = kept[0]
    files = {f for _, s, f in kept if s != sha}
    shas = {s for _, s, f in kept if f != file}
    return (sha != row[1] and (not files or len(files) == 1 and row[2] not in files)) or (file != row[2] and (not shas or len(shas) == 1 and row[1] not in shas))


def _ahead(row: tuple, kept: list) -> list:
    """The rows that matter of `row` and those after it: for any (sha, file) the first one of
    another commit and another file is among them, and they are never more than four."""
    out = [row]
    for k in kept:
        if _needed(out, k):
            out.append(k)
    return out


def _buckets(batches):
    """(bucket, ids, rows) of ordered batches of bucket, id, sha, file."""
    at, rows, kind = None, [], None
    for batch in batches:
        kind = batch.column(1).type
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at and rows:
                yield at, rows, kind
                rows = []
            at = bucket
            rows.append(tuple(row))
    if rows:
        yield at, rows, kind


def _heads(batches):
    for bucket, rows, kind in _buckets(batches):
        kept: list = []
        for row in reversed(rows):
            kept = _ahead(row, kept)
        ids, shas, files = zip(*kept, strict=True)
        yield pa.RecordBatch.from_pydict({"bucket": [bucket] * len(kept), "no": pa.array(range(len(kept)), pa.int32()), "id": pa.array(ids, kind), "sha": list(shas), "file": list(files)})


def _partners(after: dict):
    def run(batches):
        for bucket, rows, kind in _buckets(batches):
            kept, ids, others = after[bucket], [], []
            for row in reversed(rows):
                found = next((k for k in kept if k[1] != row[1] and k[2] != row[2]), None)
                if found is not None:
                    ids.append(row[0])
                    others.append(found[0])
                kept = _ahead(row, kept)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, kind), "other_id": pa.array(others, kind)})

    return run


def shuffled_negatives(pairs: DataFrame, seed: str) -> DataFrame:
    """Each pair's claim with the hunk of the next pair of another commit and
    another file, in the order of a seeded hash, that starts anew at its end. Only
    pairs that have none in the whole table, or no commit or file, are left out.
    pairs: id, sha, file.

    Buckets of the hash are scanned from their end; of what lies after a row at
    most four rows matter (_ahead). 4,096 buckets with four rows each go to the
    driver, whatever the table's size, and tell each bucket what follows it."""
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit(seed)).cast("binary"))
    sha, file = F.col("sha").cast("string").alias("sha"), F.col("file").cast("string").alias("file")
    named = pairs.where("sha is not null and file is not null").select(F.coalesce(F.substring(h, 1, 3), F.lit("")).alias("bucket"), "id", sha, file, h.alias("__h"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.repartition(n, "bucket").sortWithinPartitions("bucket", "__h", "id").drop("__h")
    kind = pairs.schema["id"].dataType
    schema = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("no", T.IntegerType()), T.StructField("id", kind), T.StructField("sha", T.StringType()), T.StructField("file", T.StringType())])
    heads: dict[str, list] = {}
    for r in sorted(ordered.mapInArrow(_heads, schema).collect(), key=lambda r: (r.bucket, r.no)):
        heads.setdefault(r.bucket, []).append((r.id, r.sha, r.file))
    after, kept = {}, []
    for bucket in sorted(heads, reverse=True) * 2:  # the second time round, kept holds what comes after the end too
        after[bucket] = kept
        for row in reversed(heads[bucket]):
            kept = _ahead(row, kept)
    return ordered.mapInArrow(_partners(after), T.StructType([T.StructField("id", kind), T.StructField("other_id", kind)]))


def session_outcome(code: Column, missing: Column) -> Column:
    """What a session's reconciliation says, by its return code and the number
    of files without a gate event: clean, gap, or infrastructure for all else
    (a code of 0 with missing files too, and a null code)."""
    return F.when((code == 0) & (F.coalesce(missing, F.lit(0)) == 0), "clean").when(code == 1, "gap").otherwise("infrastructure")
