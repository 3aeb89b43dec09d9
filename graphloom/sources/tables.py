"""The driver tables as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.graph import EdgeFrame, Graph, keyed

#: Each label has a range of ids of its own.
WIDTH = 10**12
OFFSETS = {label: k * WIDTH for k, label in enumerate(["Customer", "Order", "Part", "Supplier", "Nation", "Region", "User", "Event", "Doc", "Vec", "Page", "Turn"])}


def from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables of a folder; each is opened on first use, once for a graph."""
    opened: dict[str, DataFrame] = {}

    def t(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def node(name: str, key: str, label: str):
        return keyed(lambda: t(name), key, OFFSETS[label])

    def end(label: str, c: str) -> Column:
        return F.col(c).cast("bigint") + F.lit(OFFSETS[label])

    def edge(name: str, eid: str, a: str, src: str, b: str, dst: str) -> EdgeFrame:
        """Edges that stand in the rows of the node whose key is ``eid``."""
        ends = lambda: (F.col(eid).cast("bigint").alias("eid"), end(a, src).alias("src"), end(b, dst).alias("dst"), F.lit(0).alias("port"))
        host = ("src", nodes[a]) if src == eid else ("dst", nodes[b])
        return EdgeFrame(lambda: t(name).select(*ends()), a, b, (host[0], lambda: t(name).select("*", *ends()), host[1]))

    def line(b: str, dst: str, props: list[str]) -> EdgeFrame:
        # line items repeat their key, so the edge id is a hash of all that tells two apart
        return EdgeFrame(lambda: t("lineitem").select(F.xxhash64(*t("lineitem").columns).alias("eid"), end("Order", "l_orderkey").alias("src"), end(b, dst).alias("dst"), F.col("l_linenumber").cast("int").alias("port"), *props), "Order", b)

    def ring() -> DataFrame:
        """Customer k is linked to k + 1, k + 2 and 7 k + 1, round the number of customers."""
        k, n = F.col("c_custkey"), F.col("n")
        ends = F.array(*[F.struct(F.lit(j).alias("port"), F.pmod(to, n).alias("to")) for j, to in enumerate((k + 1, k + 2, 7 * k + 1))])
        all_ = t("customer").agg(F.count("*").alias("n"))
        e = t("customer").crossJoin(F.broadcast(all_)).select(k.alias("k"), F.explode(ends).alias("e"))
        return e.select((F.col("k") * 3 + F.col("e.port")).alias("eid"), end("Customer", "k").alias("src"), (F.col("e.to") + F.lit(OFFSETS["Customer"])).alias("dst"), F.col("e.port").cast("int").alias("port"))

    def chain() -> DataFrame:
        """Each order leads to the customer's next one."""
        following = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        pairs = t("orders").select("o_orderkey", following.alias("next")).filter("next IS NOT NULL")
        return pairs.select(F.col("o_orderkey").alias("eid"), end("Order", "o_orderkey").alias("src"), end("Order", "next").alias("dst"), F.lit(0).alias("port"))

    nodes = {
        "Customer": node("customer", "c_custkey", "Customer"),
        "Order": node("orders", "o_orderkey", "Order"),
        "Part": node("part", "p_partkey", "Part"),
        "Supplier": node("supplier", "s_suppkey", "Supplier"),
        "Nation": node("nation", "n_nationkey", "Nation"),
        "Region": node("region", "r_regionkey", "Region"),
        "User": keyed(lambda: t("events").select("user_id").distinct(), "user_id", OFFSETS["User"]),
        "Event": node("events", "event_id", "Event"),
        "Doc": node("documents", "doc_id", "Doc"),
        "Vec": node("embeddings", "vec_id", "Vec"),
    }
    edges = {
        "IN_REGION": edge("nation", "n_nationkey", "Nation", "n_nationkey", "Region", "n_regionkey"),
        "IN_NATION": edge("customer", "c_custkey", "Customer", "c_custkey", "Nation", "c_nationkey"),
        "BASED_IN": edge("supplier", "s_suppkey", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
        "PLACED": edge("orders", "o_orderkey", "Customer", "o_custkey", "Order", "o_orderkey"),
        "CONTAINS": line("Part", "l_partkey", ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]),
        "SUPPLIED_BY": line("Supplier", "l_suppkey", ["l_quantity"]),
        "DID": edge("events", "event_id", "User", "user_id", "Event", "event_id"),
        "LINK": EdgeFrame(ring, "Customer", "Customer"),
        "NEXT": EdgeFrame(chain, "Order", "Order"),
    }
    return Graph(spark, nodes, edges)
