"""Rendezvous sharding: records go to weighted shards by hashing a stable key.

Every (key, shard) pair has a uniform number u from the key and the shard's number alone; a record goes to the shard
with the least -ln(u) / weight. A new shard can only win records for itself, so nothing moves between old shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots are dealt within this many sub-buckets of each shard, so that no task sorts a whole shard.
SUB_BUCKETS = 4096


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5('key:shard')."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), shard.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) weighted shards; the lower number wins a tie."""
    costs = F.array(*[F.struct((-F.ln(draw(key, F.lit(s))) / float(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)])
    return F.array_min(costs)["shard"]


def assign_shards(df: DataFrame, key: str, weights: list[float], order: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with its shard and a gapless slot from 0 within the shard.

    Null keys are one key. The slot follows (sub-bucket, order); rows equal in all of order may swap slots. Sub-buckets
    hash key and order, so a hot key's rows spread unless they are alike in every column of order. An empty df gives no rows.
    """
    cols = [F.col(c) for c in dict.fromkeys([key, *order])]
    df = df.withColumn(shard, shard_of(F.col(key), weights)).withColumn("_sub", F.pmod(F.xxhash64(*cols), F.lit(SUB_BUCKETS)).cast("int"))
    from pyspark.sql import Window

    counts = df.groupBy(F.col(shard).alias("_shard"), F.col("_sub").alias("_s")).agg(F.count("*").alias("_n"))
    # at most len(weights) * SUB_BUCKETS rows, whatever the input
    before = Window.partitionBy("_shard").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_sub").orderBy(*cols)
    numbered = df.withColumn("_row", F.row_number().over(within))
    joined = numbered.join(F.broadcast(starts), (F.col(shard) == F.col("_shard")) & (F.col("_sub") == F.col("_s")))
    return joined.withColumn(slot, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_sub", "_shard", "_s", "_start", "_row")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, slot and the shard with one more shard for each document.

    Null text has size 1 and crc32 0; a null doc_id is the key 'null'; repeated rows get a slot each; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(base, "doc_id", [1.0] * shards, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", shard_of(F.col("doc_id"), [1.0] * (shards + 1)).cast("int").alias("grown_shard"))
