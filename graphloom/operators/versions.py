"""An append-only log of changes, states of it at a time, and slices of it.

Log columns: tx_id, ts, op, entity, id, label, key, value, src, dst. Operations: begin, commit, rollback,
create_node, create_edge, set, delete_node, delete_edge.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.graph import EdgeFrame, Graph, NodeFrame

LOG_SCHEMA = "tx_id bigint, ts timestamp_ntz, op string, id bigint, label string, key string, value string, src bigint, dst bigint"


def committed(log: DataFrame) -> DataFrame:
    """The changes of transactions that have a commit entry: a tail without one never took place."""
    done = log.filter("op = 'commit'").select("tx_id").distinct()
    return log.filter("op NOT IN ('begin', 'commit', 'rollback')").join(done, "tx_id", "left_semi")


def tx_at(log: DataFrame, moment) -> DataFrame:
    """One row with the last transaction committed at or before the moment, NULL if there is none."""
    return log.filter((F.col("op") == "commit") & (F.col("ts") <= F.lit(moment).cast("timestamp_ntz"))).agg(F.max("tx_id").alias("tx_id"))


def latest(changes: DataFrame, keys: list[str], order: str = "tx_id") -> DataFrame:
    """The last change of each key: one partial and one final aggregation, no sort of the log."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def nodes_at(log: DataFrame, tx: int | None = None) -> DataFrame:
    """(id, label) of the nodes that exist after transaction tx."""
    seen = committed(log if tx is None else log.filter(F.col("tx_id") <= tx)).filter("op IN ('create_node', 'delete_node')")
    return latest(seen.select("id", "tx_id", "op", "label"), ["id"]).filter("op = 'create_node'").select("id", "label")


def properties_at(log: DataFrame, tx: int | None = None) -> DataFrame:
    """(id, key, value) after transaction tx, of nodes that exist then."""
    seen = committed(log if tx is None else log.filter(F.col("tx_id") <= tx)).filter("op = 'set'")
    now = latest(seen.select("id", "key", "tx_id", "value"), ["id", "key"]).filter("value IS NOT NULL")
    return now.join(nodes_at(log, tx), "id", "left_semi").select("id", "key", "value")


def edges_at(log: DataFrame, tx: int | None = None) -> DataFrame:
    """(src, dst, label) of the edges that exist after tx; those of deleted nodes go with them."""
    seen = committed(log if tx is None else log.filter(F.col("tx_id") <= tx)).filter("op IN ('create_edge', 'delete_edge')")
    live = latest(seen.select("src", "dst", "label", "tx_id", "op"), ["src", "dst", "label"]).filter("op = 'create_edge'").select("src", "dst", "label")
    nodes = nodes_at(log, tx).select("id")
    return live.join(nodes, F.col("src") == F.col("id"), "left_semi").join(nodes.withColumnRenamed("id", "id2"), F.col("dst") == F.col("id2"), "left_semi")


def delta(log: DataFrame, base: int, upto: int) -> DataFrame:
    """The committed changes after base up to and with upto: what a checkpoint at upto adds to one at base."""
    return committed(log.filter((F.col("tx_id") > base) & (F.col("tx_id") <= upto)))


def vacuum(log: DataFrame, keep_from: int) -> DataFrame:
    """The log without property values that no state from keep_from on can show."""
    later = F.lead("tx_id").over(W.partitionBy("id", "key").orderBy("tx_id"))
    sets = log.filter("op = 'set'").withColumn("_next", later).filter(F.col("_next").isNull() | (F.col("_next") > keep_from)).drop("_next")
    return log.filter("op <> 'set'").unionByName(sets)


# from graphs to the log, and back


def _entry(df: DataFrame, tx: int, when: datetime, op: str, **values: Column) -> DataFrame:
    kinds = dict(x.strip().rsplit(" ", 1) for x in LOG_SCHEMA.split(","))
    fixed = {"tx_id": F.lit(tx), "ts": F.lit(when).cast("timestamp_ntz"), "op": F.lit(op)}
    return df.select(*[(fixed.get(c) if c in fixed else values.get(c, F.lit(None))).cast(t).alias(c) for c, t in kinds.items()])


def _properties(df: DataFrame, props: list[str]) -> DataFrame:
    """(id, key, value) of every property, each value as JSON, so that reading gives back its type."""
    value = lambda p: F.to_json(F.struct(F.col(f"`{p}`").alias("v")))
    return df.select("id", F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p in props]), F.array(*[value(p) for p in props]))).alias("key", "value")) if props else df.select("id", F.lit("").alias("key"), F.lit("").alias("value")).limit(0)


def changes(before: Graph, after: Graph, tx: int, when: datetime) -> DataFrame:
    """The log entries that lead from one version to the next, with their commit: frames that are the same object are
    not looked at, the others are compared by hash joins on their ids."""
    spark = after.spark
    out = [_entry(spark.range(1), tx, when, "commit")]
    empty = spark.range(0)
    for label in {**before.nodes, **after.nodes}:
        old, new = before.nodes.get(label), after.nodes.get(label)
        if old is new:
            continue
        a, b = (old.df if old else empty), (new.df if new else empty)
        out.append(_entry(b.join(a.select("id"), "id", "left_anti"), tx, when, "create_node", id=F.col("id"), label=F.lit(label)))
        out.append(_entry(a.join(b.select("id"), "id", "left_anti"), tx, when, "delete_node", id=F.col("id"), label=F.lit(label)))
        pa_, pb = _properties(a, old.props if old else []), _properties(b, new.props if new else [])
        same = pa_.select("id", "key", F.col("value").alias("was"))
        moved = pb.join(same, ["id", "key"], "left").filter("NOT value <=> coalesce(was, '{}')")
        out.append(_entry(moved, tx, when, "set", id=F.col("id"), key=F.col("key"), value=F.col("value")))
    for kind in {**before.edges, **after.edges}:
        old_e, new_e = before.edges.get(kind), after.edges.get(kind)
        if old_e is new_e:
            continue
        ends = [(e.df.select("src", "dst").distinct() if e else empty.select(F.col("id").alias("src"), F.col("id").alias("dst"))) for e in (old_e, new_e)]
        for op, a, b in (("create_edge", ends[1], ends[0]), ("delete_edge", ends[0], ends[1])):
            out.append(_entry(a.join(b, ["src", "dst"], "left_anti"), tx, when, op, label=F.lit(kind), src=F.col("src"), dst=F.col("dst")))
    return reduce(DataFrame.unionByName, out)


def append(path: str, entries: DataFrame) -> None:
    """One write, so that a transaction's changes and its commit appear together."""
    entries.write.mode("append").parquet(path)


def recover(log: DataFrame, schema: dict[str, str], tx: int | None = None) -> Graph:
    """The graph after transaction tx, or the last one, with each label's properties read as the given types
    ("name string, age bigint"). A tail without a commit never took place. Parallel edges of a type are one."""
    known, values, ends = nodes_at(log, tx), properties_at(log, tx), edges_at(log, tx)
    graph = Graph(log.sparkSession)
    for label, types in schema.items():
        own = known.filter(F.col("label") == label).select("id")
        fields = [x.strip().split(" ", 1) for x in types.split(",")] if types else []
        if fields:
            wide = values.groupBy("id").agg(*[F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n, _ in fields])
            typed = [F.from_json(F.col(f"`{n}`"), f"v {t}").getField("v").alias(n) for n, t in fields]
            own = own.join(wide, "id", "left").select("id", *typed)
        graph = graph.with_nodes(label, NodeFrame(own))
    for r in ends.select("label").distinct().collect():
        rows = ends.filter(F.col("label") == r.label).select(F.xxhash64("src", "dst").alias("eid"), "src", "dst", F.lit(0).alias("port"))
        graph = graph.with_edges(r.label, EdgeFrame(rows))
    return graph
