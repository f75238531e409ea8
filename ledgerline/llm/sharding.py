"""Rendezvous (highest random weight) hashing over weighted shards.

A row goes to the shard with the highest weight / -ln(u), u the hash of key and
shard as a number in (0, 1). A new shard takes only the rows for which it wins;
no row moves between old shards. Slots within a shard come from counts per
(shard, bucket), so that no shard's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import column, materialize, shuffle_partitions

#: rows of a shard that are numbered in one window partition, about
BUCKET_ROWS = 5_000
#: equal rows that one task deals out
COPIES = 100_000


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight, u the first 52 bits of md5(key:shard) in (0, 1); the least cost wins."""
    digest = F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def winner(key: Column, weights: Sequence[float]) -> Column:
    """(cost, shard) of the shard (0 ...) that a string key goes to; ties go to
    the smallest. Shards of weight 0 take nothing."""
    live = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights) if w > 0])
    return F.array_min(F.transform(live, lambda x: F.struct(_cost(key, x["k"], x["w"]).alias("cost"), x["k"].alias("shard"))))


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    weights: of each shard, 0 for none. grown: the weight of one more shard,
    under which grown_shard is the new place. Null ids share one key, null texts
    have size 16 and the crc of no bytes. Repeated rows go to the same shard in
    slots of their own; an empty table gives an empty one; other columns aren't
    carried. Slots have no gaps; their order within a shard goes by buckets,
    whose number grows with the table, so it is another one for more rows.

    Rows that are equal in what is returned are counted before they are
    numbered, and dealt out again afterwards, COPIES at a time; rows that only
    share an id (or have none) are in buckets by their text's crc as well.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    few = docs.select(
        column(docs, id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = materialize(few.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "counted")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    n = len(weights)
    rows = rows.withColumn("best", winner(key, weights)).withColumn("extra", _cost(key, F.lit(n), F.lit(float(grown))))
    rows = rows.select(
        "doc_id", "size", "text_crc32", "n", F.col("best.shard").alias("shard"),
        F.when(F.col("extra") < F.col("best.cost"), F.lit(n)).otherwise(F.col("best.shard")).alias("grown_shard"),
    )
    rows = materialize(rows, "sharded")
    buckets = max(1, -(-rows.count() // (BUCKET_ROWS * max(1, n))))
    spread = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.col("text_crc32").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    place = F.sum("n").over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = rows.withColumn("place", place - F.col("n")).join(offsets, ["shard", "bucket"])
    first = (F.col("offset") + F.col("place")).alias("slot")
    out = materialize(numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", first, "grown_shard", "n"), "numbered")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    chunks = out.where("n > 1").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    again = chunks.repartition(shuffle_partitions(docs.sparkSession), "doc_id", "size", "text_crc32", "k")
    again = again.withColumn("j", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + COPIES, F.col("n")) - 1))).withColumn("slot", F.col("slot") + F.col("j"))
    return out.where("n = 1").select(names).unionByName(again.select(names))
