"""Operator 10: sharding through fixed virtual slots.

A record is hashed once into one of ``n_slots`` slots, for good. Which shard holds a slot is looked up in a
small versioned map, so growing or rebalancing the cluster edits at most ``n_slots`` map rows and moves only
the records of the slots that changed hands.

Defined results: a NULL id hashes as the empty string and so has one fixed slot; NULL and empty text count 0
bytes, a very long text all of its bytes; equal ids (repeated rows, ties) share their slot; an empty table gives a map over 0 bytes and no assignments. Columns
beyond the id and the text are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.storage import fresh_path

N_SLOTS = 4096
N_SHARDS = 16
GROWN_SHARDS = 20


def slot_of(doc_id: Column, n_slots: int = N_SLOTS) -> Column:
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % n_slots


def slot_bytes(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(slot, bytes) for each of the ``n_slots`` slots; the shuffle carries at most n_slots rows a task."""
    used = (
        docs.select(slot_of(F.col("doc_id"), n_slots).alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("b"))
        .groupBy("slot")
        .agg(F.sum("b").alias("bytes"))
    )
    every = docs.sparkSession.range(n_slots).select(F.col("id").alias("slot"))
    return every.join(used, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def initial_map(bytes_by_slot: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1: consecutive slots to each shard."""
    return bytes_by_slot.select(F.lit(1).cast("bigint").alias("version"), "slot", F.floor(F.col("slot") * n_shards / n_slots).cast("bigint").alias("shard"), "bytes")


def rebalance(current: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map over shards 0..n_shards-1.

    Each shard keeps its slots, largest first, while their running bytes stay within the fair share (total /
    n_shards, rounded up); shards beyond n_shards keep none. What is left over is laid end to end, largest
    first, and cut at the running room of the shards: a slot goes to the shard in whose stretch it starts.
    All windows here run over the slots of the map, whose number is fixed, never over records.
    """
    total = W.partitionBy()
    running = W.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0)
    marked = (
        current.withColumn("fair", F.ceil(F.sum("bytes").over(total) / n_shards).cast("bigint"))
        .withColumn("run", F.sum("bytes").over(running))
        .withColumn("stays", (F.col("shard") < n_shards) & (F.col("run") <= F.col("fair")))
    )
    held = marked.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    fair = marked.agg(F.max("fair").alias("fair"))
    shards = current.sparkSession.range(n_shards).select(F.col("id").alias("dest"))
    upto = W.orderBy("dest").rowsBetween(W.unboundedPreceding, 0)
    room = (
        shards.join(held, F.col("dest") == F.col("shard"), "left")
        .crossJoin(fair)
        .select("dest", (F.col("fair") - F.coalesce("held", F.lit(0))).alias("room"))
        .withColumn("end", F.sum("room").over(upto))
        .select("dest", (F.col("end") - F.col("room")).alias("start"), "end")
    )
    laid = W.orderBy(F.desc("bytes"), "slot").rowsBetween(W.unboundedPreceding, 0)
    loose = marked.filter("NOT stays").withColumn("at", F.sum("bytes").over(laid) - F.col("bytes")).withColumn("nth", F.row_number().over(W.orderBy(F.desc("bytes"), "slot")) - 1)
    landed = loose.join(F.broadcast(room), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")), "left")
    moved = landed.select((F.col("version") + 1).alias("version"), "slot", F.coalesce("dest", F.col("nth") % n_shards).cast("bigint").alias("shard"), "bytes")
    stayed = marked.filter("stays").select((F.col("version") + 1).alias("version"), "slot", "shard", "bytes")
    return stayed.unionByName(moved)


def store_version(slot_map: DataFrame, path: str, version: int) -> None:
    """Each version is a folder of its own, never rewritten."""
    slot_map.select("slot", "shard", "bytes").coalesce(1).write.parquet(f"{path}/version={version}")


def load_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    kept = spark.read.schema("slot BIGINT, shard BIGINT, bytes BIGINT").parquet(f"{path}/version={version}")
    return kept.select(F.lit(version).cast("bigint").alias("version"), "slot", "shard", "bytes")


def assign(docs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS, name: str = "shard") -> DataFrame:
    """doc_id, slot and shard of every record. The map has n_slots rows by construction, so it is broadcast."""
    records = docs.select("doc_id", slot_of(F.col("doc_id"), n_slots).alias("slot"))
    return records.join(F.broadcast(slot_map.select("slot", F.col("shard").alias(name))), "slot")


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "slot-map")
    store_version(initial_map(slot_bytes(docs)), path, 1)
    first = load_version(spark, path, 1)
    store_version(rebalance(first, GROWN_SHARDS), path, 2)
    second = load_version(spark, path, 2)
    both = assign(docs, first, name="shard_v1").join(F.broadcast(second.select("slot", F.col("shard").alias("shard_v2"))), "slot")
    return both.select("doc_id", "slot", "shard_v1", "shard_v2", (F.col("shard_v1") != F.col("shard_v2")).alias("moved"))


SQL = f"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {N_SLOTS} AS slot, coalesce(strlen(text), 0) AS b FROM documents),
u AS (SELECT slot, sum(b)::BIGINT AS bytes FROM d GROUP BY slot),
m AS (SELECT r.slot, coalesce(u.bytes, 0) AS bytes, floor(r.slot * {N_SHARDS} / {N_SLOTS})::BIGINT AS shard FROM range({N_SLOTS}) r(slot) LEFT JOIN u ON u.slot = r.slot),
f AS (SELECT ceil(sum(bytes) / {GROWN_SHARDS})::BIGINT AS fair FROM m),
k AS (SELECT m.*, fair, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) <= fair AND shard < {GROWN_SHARDS} AS stays FROM m, f),
h AS (SELECT shard, sum(bytes) AS held FROM k WHERE stays GROUP BY shard),
r AS (SELECT s.dest, fair - coalesce(held, 0) AS room, sum(fair - coalesce(held, 0)) OVER (ORDER BY s.dest ROWS UNBOUNDED PRECEDING) AS stop FROM range({GROWN_SHARDS}) s(dest) CROSS JOIN f LEFT JOIN h ON h.shard = s.dest),
l AS (SELECT slot, sum(bytes) OVER (ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) - bytes AS pos, row_number() OVER (ORDER BY bytes DESC, slot) - 1 AS nth FROM k WHERE NOT stays),
n AS (SELECT l.slot, coalesce(r.dest, nth % {GROWN_SHARDS})::BIGINT AS shard FROM l LEFT JOIN r ON pos >= stop - room AND pos < stop UNION ALL SELECT slot, shard FROM k WHERE stays)
SELECT d.doc_id, d.slot, m.shard AS shard_v1, n.shard AS shard_v2, m.shard <> n.shard AS moved FROM d JOIN m ON m.slot = d.slot JOIN n ON n.slot = d.slot
"""
