"""Operator 2: best-fit-decreasing packing of documents into fixed-length sequences.

Lengths are whole numbers up to the capacity, so all documents of one length are alike to best-fit
decreasing. The plan is therefore made over the histogram of lengths (at most ``capacity`` rows, however many
documents there are): a segment tree over remaining capacities finds the tightest open bin, and a whole run
of equal documents goes through bins of equal room in one step. The result is bin for bin that of packing
document by document. The documents learn their bins by their rank among those of their length, which is
counted in two steps (fixed hash buckets, then within a bucket), so that no task ever holds one length's
documents, let alone all.

A document longer than the capacity is cut into full pieces and a rest; all of it is packed.

Defined results: NULL or empty text takes no room and comes back as one row with length 0 and bin NULL. Equal
lengths are ranked by (bucket, doc_id, piece), repeated rows one after the other. An empty table gives no
rows. Only the id and the text are read.
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import table, words
from graphloom.storage import materialise

CAPACITY = 2048
BUCKETS = 1024


class RoomTree:
    """Segment tree over remaining capacities 0..capacity; a leaf tells whether some open bin has that room."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        self.open = bytearray(2 * self.size)

    def set(self, room: int, value: bool) -> None:
        at = room + self.size
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The smallest room >= need of an open bin, or -1; logarithmic in the capacity."""
        at = need + self.size
        if at >= 2 * self.size:
            return -1
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first bin, items a bin, offset in the bin), longest lengths first.

    Within a run, the item of rank first + j goes to bin first_bin + j // per_bin at offset + j % per_bin *
    length. Bins of one room are used in the order in which they came to have it.
    """
    tree = RoomTree(capacity)
    rooms: dict[int, deque[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, count: int) -> None:
        if not room or not count:
            return
        line = rooms.setdefault(room, deque())
        if line and line[-1][0] + line[-1][1] == first:
            line[-1] = (line[-1][0], line[-1][1] + count)
        else:
            line.append((first, count))
        tree.set(room, True)

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = rooms[room].popleft()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length
            use = min(count, -(-left // each))
            if use < count:
                rooms[room].appendleft((first + use, count - use))
                tree.set(room, True)
            items = min(left, use * each)
            runs.append((length, rank, items, first, each, capacity - room))
            rest = items - (use - 1) * each
            put(room - each * length, first, use - (rest < each))
            if rest < each:
                put(room - rest * length, first + use - 1, 1)
            rank, left = rank + items, left - items
    return runs


def pieces_of(docs: DataFrame, capacity: int, length: Column) -> DataFrame:
    cut = docs.select("doc_id", length.cast("bigint").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    every = cut.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return every.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("bigint") * capacity).cast("int").alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None) -> DataFrame:
    """doc_id, piece, length, bin_id, bin_offset of every piece; the length is in words unless given."""
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")
    # four numbers a piece, kept: the texts are read once
    pieces = materialise(pieces_of(docs, capacity, words(F.col("text")) if length is None else length).withColumn("bucket", bucket), "pieces")
    sizes = pieces.filter("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("items"))
    # at most capacity x BUCKETS rows
    upto = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("items").over(upto), F.lit(0)).alias("start"), "items")
    histogram = {r.length: r.items for r in starts.groupBy("length").agg(F.sum("items").alias("items")).collect()}
    runs = plan(histogram, capacity)
    # by length and rank; its size is bounded by the capacity, not by the documents
    runs.sort()
    table_ = np.array(runs, dtype=np.int64).reshape(-1, 6)
    shipped = spark.sparkContext.broadcast(table_)

    @F.pandas_udf("bin_id bigint, bin_offset int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shipped.value
        wide = np.int64(1) << 44
        at = np.searchsorted(t[:, 0] * wide + t[:, 1], length.to_numpy(np.int64) * wide + rank.to_numpy(np.int64), side="right") - 1
        r = t[at]
        j = rank.to_numpy(np.int64) - r[:, 1]
        return pd.DataFrame({"bin_id": r[:, 3] + j // r[:, 4], "bin_offset": (r[:, 5] + j % r[:, 4] * r[:, 0]).astype(np.int32)})

    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = (
        pieces.filter("length > 0")
        .withColumn("nth", within)
        .join(starts.select("length", "bucket", "start"), ["length", "bucket"])
        .select("doc_id", "piece", "length", (F.col("start") + F.col("nth") - 1).alias("rank"))
    )
    placed = ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "length", "at.bin_id", "at.bin_offset")
    nothing = pieces.filter("length <= 0").select("doc_id", "piece", "length", F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"))
    return placed.unionByName(nothing)


def brute_force(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item, packed one by one, longest first, ties in the given order."""
    bins: list[int] = [-1] * len(lengths)
    free: list[tuple[int, int, int]] = []
    used = moves = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(free, (lengths[i], -1, -1))
        if at == len(free):
            room, b = capacity, used
            used += 1
        else:
            room, _, b = free.pop(at)
        bins[i] = b
        moves += 1
        if room > lengths[i]:
            bisect.insort(free, (room - lengths[i], moves, b))
    return bins


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
