"""Graphs from and to files: CSV, Parquet, JSON entities, versioned snapshots, and the change log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import EdgeFrame, Graph, NodeFrame


def nodes_csv(spark: SparkSession, path: str, schema: str | None = None) -> dict[str, NodeFrame]:
    """Header ``id[,label],properties``. Types are inferred unless a schema is given; empty cells are NULL."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if "id" not in df.columns:
        raise ValueError("a node file needs a column id")
    df = df.withColumn("id", F.col("id").cast("bigint"))
    if "label" not in df.columns:
        return {"": NodeFrame(df)}
    labels = sorted(r[0] or "" for r in df.select("label").distinct().collect())
    return {x: NodeFrame(df.filter(F.coalesce("label", F.lit("")) == x).drop("label")) for x in labels}


def edges_csv(spark: SparkSession, path: str) -> dict[str, EdgeFrame]:
    """Header ``source,target[,label or type],properties``."""
    df = spark.read.option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if not {"source", "target"} <= set(df.columns):
        raise ValueError("an edge file needs the columns source and target")
    kind = next((c for c in ("label", "type") if c in df.columns), None)
    props = [c for c in df.columns if c not in ("source", "target", kind)]
    df = df.select(F.monotonically_increasing_id().alias("eid"), F.col("source").cast("bigint").alias("src"), F.col("target").cast("bigint").alias("dst"), F.lit(0).alias("port"), *props, (F.col(kind) if kind else F.lit("")).alias("_kind"))
    kinds = sorted(r[0] or "" for r in df.select("_kind").distinct().collect())
    return {k: EdgeFrame(df.filter(F.coalesce("_kind", F.lit("")) == k).drop("_kind")) for k in kinds}


def graph_csv(spark: SparkSession, nodes: str, edges: str) -> Graph:
    return Graph(spark, nodes_csv(spark, nodes), edges_csv(spark, edges))


def graph_json(spark: SparkSession, nodes: str, edges: str) -> Graph:
    """JSON lines: nodes {"id", "label", properties...}, edges {"source", "target", "type" or "label", properties...}.

    A folder without files gives a graph without nodes or edges. Types are those that the values have.
    """
    graph = Graph(spark)
    df = spark.read.json(nodes)
    if "id" in df.columns:
        df = df.withColumn("id", F.col("id").cast("bigint"))
        label = F.coalesce(F.col("label"), F.lit("")) if "label" in df.columns else F.lit("")
        df = df.withColumn("_label", label).drop("label")
        for name in sorted(r[0] for r in df.select("_label").distinct().collect()):
            graph = graph.with_nodes(name, NodeFrame(df.filter(F.col("_label") == name).drop("_label")))
    e = spark.read.json(edges)
    if {"source", "target"} <= set(e.columns):
        kind = next((c for c in ("type", "label") if c in e.columns), None)
        props = [c for c in e.columns if c not in ("source", "target", kind)]
        e = e.select(F.monotonically_increasing_id().alias("eid"), F.col("source").cast("bigint").alias("src"), F.col("target").cast("bigint").alias("dst"), F.lit(0).alias("port"), *props, (F.coalesce(kind, F.lit("")) if kind else F.lit("")).alias("_kind"))
        for name in sorted(r[0] for r in e.select("_kind").distinct().collect()):
            graph = graph.with_edges(name, EdgeFrame(e.filter(F.col("_kind") == name).drop("_kind")))
    return graph


def nodes_parquet(spark: SparkSession, path: str, key: str | None = None) -> NodeFrame:
    """All columns are properties. Without a key column rows are numbered, uniquely but with gaps."""
    df = spark.read.parquet(path)
    return NodeFrame(df.withColumn("id", F.col(key).cast("bigint") if key else F.monotonically_increasing_id()))


def save(graph: Graph, path: str, version: int) -> None:
    """A snapshot: a folder for each label and type, and a manifest that is written last."""
    root = f"{path}/version={version}"
    manifest = []
    for k, (label, f) in enumerate(graph.nodes.items()):
        f.df.write.parquet(f"{root}/nodes-{k}")
        manifest.append(json.dumps({"what": "nodes", "at": f"nodes-{k}", "name": label, "key": f.key, "offset": f.offset}))
    for k, (kind, e) in enumerate(graph.edges.items()):
        e.df.write.parquet(f"{root}/edges-{k}")
        manifest.append(json.dumps({"what": "edges", "at": f"edges-{k}", "name": kind, "src": e.src_label, "dst": e.dst_label}))
    graph.spark.createDataFrame([(m,) for m in manifest], "value string").coalesce(1).write.text(f"{root}/manifest")


def load(spark: SparkSession, path: str, version: int) -> Graph:
    root = f"{path}/version={version}"
    graph = Graph(spark)
    for row in spark.read.text(f"{root}/manifest").collect():
        m = json.loads(row[0])
        df = spark.read.parquet(f"{root}/{m['at']}")
        graph = graph.with_nodes(m["name"], NodeFrame(df, m["key"], m["offset"])) if m["what"] == "nodes" else graph.with_edges(m["name"], EdgeFrame(df, m["src"], m["dst"]))
    return graph


ETL = "entities array<struct<name: string, type: string>>, relations array<struct<source: string, target: string, type: string>>"


def entities_and_relations(extracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From extracts (doc, json): entities (id, name, type), each name once, and relations (src, dst, type).

    Of several types of a name the greatest counts; ids are hashes of the names, so documents need not agree on
    a numbering. Relations between unknown names are dropped; text that isn't JSON gives nothing.
    """
    parsed = extracts.select(F.from_json("json", ETL, {"mode": "PERMISSIVE"}).alias("j"))
    entity = parsed.select(F.explode("j.entities").alias("e")).select("e.name", "e.type").filter("name IS NOT NULL")
    nodes = entity.groupBy("name").agg(F.max("type").alias("type")).select(F.xxhash64("name").alias("id"), "name", "type")
    rel = parsed.select(F.explode("j.relations").alias("r")).select("r.source", "r.target", "r.type")
    a = nodes.select(F.col("name").alias("source"), F.col("id").alias("src"))
    b = nodes.select(F.col("name").alias("target"), F.col("id").alias("dst"))
    return nodes, rel.join(a, "source").join(b, "target").select("src", "dst", "type")


def pages_of_text(docs: DataFrame) -> DataFrame:
    """(id, page, text): texts (id, text) cut at form feeds."""
    return docs.select("id", F.posexplode(F.split("text", "\f", -1)).alias("page", "text"))
