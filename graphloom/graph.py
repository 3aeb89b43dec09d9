"""A property graph as typed DataFrames: one per node label, one per edge type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Frame:
    """Holds a DataFrame, or a function that gives it: a query then opens only the tables that it touches."""

    source: DataFrame | Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()


@dataclass(frozen=True)
class NodeFrame(_Frame):
    """``df`` has ``id`` and the properties. Where ``id`` is a key column plus an offset, both are named, so
    that a search by id becomes a search by key that the scan can use."""

    source: DataFrame | Callable[[], DataFrame]
    key: str | None = None
    offset: int = 0

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != "id"]


@dataclass(frozen=True)
class EdgeFrame(_Frame):
    """``df`` has ``eid``, ``src``, ``dst``, ``port`` and the properties; the labels are those of its ends, None for any."""

    source: DataFrame | Callable[[], DataFrame]
    src_label: str | None = None
    dst_label: str | None = None
    #: where each edge stands in the row of one of its nodes: which end, the edges with that node's properties, and its frame
    host: tuple[str, Callable[[], DataFrame], NodeFrame] | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("eid", "src", "dst", "port")]


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: dict[str, NodeFrame] = field(default_factory=dict)
    edges: dict[str, EdgeFrame] = field(default_factory=dict)

    def with_nodes(self, label: str, frame: NodeFrame) -> Graph:
        return replace(self, nodes={**self.nodes, label: frame})

    def with_edges(self, kind: str, frame: EdgeFrame) -> Graph:
        return replace(self, edges={**self.edges, kind: frame})

    def node_scan(self, labels: list[str] | None, props: set[str]) -> DataFrame:
        """id, label and the wanted properties over the given labels, or all; unknown ones give no rows."""
        wanted = [p for p in sorted(props) if p not in ("id", "label", "__cluster")]
        parts = []
        for label, frame in self.nodes.items():
            if labels is None or label in labels:
                keep = [F.col(f"`{p}`") for p in wanted if p in frame.df.columns]
                parts.append(frame.df.select("id", F.lit(label).alias("label"), *keep))
        if not parts:
            return self.spark.range(0).select("id", F.lit(None).cast("string").alias("label"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def all_nodes(self) -> DataFrame:
        return self.node_scan(None, set())

    def all_edges(self) -> DataFrame:
        """eid, src, dst, type, port over all types."""
        parts = [e.df.select("eid", "src", "dst", F.lit(t).alias("type"), "port") for t, e in self.edges.items()]
        if not parts:
            return self.spark.range(0).select(F.col("id").alias("eid"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("string").alias("type"), F.lit(0).alias("port"))
        return reduce(DataFrame.unionByName, parts)

    def degrees(self) -> DataFrame:
        """id, out_degree and in_degree of every node: one pass over the edges, both ends at once."""
        ends = self.all_edges().select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        counted = ends.groupBy("e.id").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
        return self.all_nodes().join(counted, "id", "left").select("id", F.coalesce("o", F.lit(0)).cast("bigint").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("bigint").alias("in_degree"))

    def neighbours(self) -> DataFrame:
        """src and the sorted distinct targets of its edges."""
        return self.all_edges().groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))

    def has_edge(self, pairs: DataFrame, kind: str | None = None) -> DataFrame:
        """(src, dst, found): whether there is an edge, of a type if one is given, for each of the pairs (src, dst)."""
        edges = self.all_edges() if kind is None else self.edges[kind].df
        there = edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
        return pairs.join(there, ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("found"))

    def ports_between(self) -> DataFrame:
        return self.all_edges().groupBy("src", "dst", "type").agg(F.sort_array(F.collect_list("port")).alias("ports"))

    def bfs_step(self, frontier: DataFrame) -> DataFrame:
        """One sparse matrix-vector product over (+, *): ``frontier`` has id and x; so has the result."""
        return self.all_edges().join(frontier, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("x"))

    def statistics(self) -> DataFrame:
        """kind, name, value: nodes by label, edges by type, degrees over all nodes."""
        labels = self.all_nodes().groupBy("label").agg(F.count("*").alias("value")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), F.col("value").cast("double"))
        types = self.all_edges().groupBy("type").agg(F.count("*").alias("value")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), F.col("value").cast("double"))
        d = self.degrees().agg(F.count("*").alias("n"), F.sum("out_degree").alias("m"), F.max("out_degree").alias("mx"), F.min("out_degree").alias("mn"))
        shape = d.select(F.explode(F.array(*[
            F.struct(F.lit("graph").alias("kind"), F.lit(name).alias("name"), value.cast("double").alias("value"))
            for name, value in (("nodes", F.col("n")), ("edges", F.col("m")), ("max_degree", F.col("mx")), ("min_degree", F.col("mn")), ("avg_degree", F.round(F.try_divide(F.col("m"), F.col("n")), 6)))
        ])).alias("r")).select("r.*")
        return labels.unionByName(types).unionByName(shape)

    def schema(self) -> DataFrame:
        """element, name, property and its Spark type, of the elements that really have it."""
        rows = [("node", label, p, frame.df.schema[p].dataType.simpleString()) for label, frame in self.nodes.items() for p in frame.props]
        rows += [("edge", kind, p, frame.df.schema[p].dataType.simpleString()) for kind, frame in self.edges.items() for p in frame.props]
        return self.spark.createDataFrame(rows, "element string, name string, property string, type string")

    def validate(self) -> DataFrame:
        """problem, name, id: repeated node ids, and edges without a source or a target."""
        nodes = self.all_nodes()
        twice = nodes.groupBy("id").agg(F.count("*").alias("n"), F.min("label").alias("name")).filter("n > 1").select(F.lit("repeated id").alias("problem"), "name", "id")
        found = [twice]
        for end, label in (("src", "src_label"), ("dst", "dst_label")):
            for kind, frame in self.edges.items():
                wanted = getattr(frame, label)
                known = self.node_scan([wanted] if wanted else None, set()).select(F.col("id").alias("known"))
                loose = frame.df.join(known, F.col(end) == F.col("known"), "left_anti")
                found.append(loose.select(F.lit(f"no {end}").alias("problem"), F.lit(kind).alias("name"), F.col("eid").alias("id")))
        return reduce(DataFrame.unionByName, found)

    def unique_violations(self, label: str, prop: str) -> DataFrame:
        """Values of a property that more than one node of the label has; NULL counts as a value."""
        return self.nodes[label].df.groupBy(F.col(prop).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")

    def reindexed(self) -> DataFrame:
        """id and its place among all ids, from 0 on without gaps, in order of id.

        Ranges of ids are counted apart and shifted by the counts before them, so no task holds all nodes.
        """
        from graphloom.storage import materialise

        ranged = materialise(self.all_nodes().select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()), "reindex")
        from pyspark.sql import Window as W

        sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
        start = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
        local = ranged.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("id")))
        return local.join(F.broadcast(start), "part").select("id", (F.col("start") + F.col("k") - 1).alias("index"))


def literal_nodes(spark: SparkSession, rows: list[dict], schema: str) -> NodeFrame:
    return NodeFrame(spark.createDataFrame([tuple(r.get(c.split()[0].strip(), None) for c in schema.split(",")) for r in rows], schema))


def demo_graph(spark: SparkSession) -> Graph:
    """Three people and a company that they work at, joined by five untyped edges."""
    people = spark.createDataFrame([(0, "Alice", 30), (1, "Bob", 25), (2, "Charlie", 35)], "id bigint, name string, age bigint")
    company = spark.createDataFrame([(3, "Acme")], "id bigint, name string")
    edges = spark.createDataFrame([(i, s, d, 0) for i, (s, d) in enumerate([(0, 1), (0, 2), (1, 2), (0, 3), (1, 3)])], "eid bigint, src bigint, dst bigint, port int")
    return Graph(spark, {"Person": NodeFrame(people), "Company": NodeFrame(company)}, {"": EdgeFrame(edges)})


def keyed(table: Callable[[], DataFrame], key: str, offset: int) -> NodeFrame:
    """A node frame whose id is a key column shifted into the label's own range."""
    return NodeFrame(lambda: table().withColumn("id", F.col(key).cast("bigint") + F.lit(offset)), key, offset)


def edges_of(df: DataFrame, eid: Column, src: Column, dst: Column, port: Column | None = None, props: list[str] | None = None) -> DataFrame:
    return df.select(eid.cast("bigint").alias("eid"), src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), (F.lit(0) if port is None else port).cast("int").alias("port"), *(props or []))
