"""Partitionings of a graph's nodes, and how many edges they cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.storage import materialise, shuffled


def by_hash(node: Column, shards: int) -> Column:
    """The first four bytes of the id's MD5 sum, which any engine can repeat, modulo the shards."""
    return F.conv(F.substring(F.md5(node.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % shards


def by_range(node: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above the id: an id equal to a bound is in the shard after it."""
    return sum((F.when(node >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def by_community(found: DataFrame, shards: int, fine: int = 64, parts: int = 1024) -> DataFrame:
    """(id, shard): whole communities, balanced by nodes.

    Communities of more than one ``fine``-th of a shard's fair share number at most shards * fine; only they come to
    the driver, where each goes, the largest first, to the shard with the fewest nodes so far. All others are laid
    end to end, in ``parts`` ranges by hash whose sums are added up first, and cut where the shards are full.
    """
    spark = found.sparkSession
    sized = materialise(found.groupBy("community").agg(F.count("*").alias("n")), "community-sizes")
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, total // (shards * fine))
    load, at = [0] * shards, []
    for r in sorted(sized.filter(F.col("n") > least).collect(), key=lambda r: (-r["n"], r["community"])):
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += r["n"]
        at.append((r["community"], s))
    large = spark.createDataFrame(at, "community bigint, shard int")
    small = sized.filter(F.col("n") <= least).withColumn("part", F.pmod(F.xxhash64("community"), F.lit(parts)))
    rest = total - sum(load)
    room = [max(0.0, x) for x in _level(load, rest)]
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begins = small.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("begin"))
    own = W.partitionBy("part").orderBy("community").rowsBetween(W.unboundedPreceding, -1)
    laid = small.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(begins, "part").withColumn("place", F.col("begin") + F.col("before"))
    shard, end = F.lit(shards - 1), sum(room)
    for s in range(shards - 1, -1, -1):
        end -= room[s]
        shard = F.when(F.col("place") < end + room[s], F.lit(s)).otherwise(shard)
    where = large.unionByName(laid.select("community", shard.cast("int").alias("shard")))
    return found.join(where, "community").select("id", "shard")


def _level(load: list[int], rest: int) -> list[float]:
    """How much each shard takes of the rest, so that the least loaded ones are filled up evenly."""
    order, level = sorted(load), 0.0
    for k in range(1, len(load) + 1):
        level = (sum(order[:k]) + rest) / k
        if k == len(load) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in load]


def edge_cut(edges: DataFrame, shards: DataFrame) -> DataFrame:
    """edges, cut and percent of edges (src, dst) whose ends are in different shards (id, shard)."""
    a = shards.select(F.col("id").alias("src"), F.col("shard").alias("a"))
    b = shards.select(F.col("id").alias("dst"), F.col("shard").alias("b"))
    ends = shuffled(shuffled(edges).join(a, "src")).join(b, "dst").agg(F.count("*").alias("edges"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("cut"))
    return ends.select("edges", "cut", F.round(F.coalesce(F.try_divide(100 * F.col("cut"), F.col("edges")), F.lit(0.0)), 4).alias("percent"))
