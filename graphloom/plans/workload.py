"""The registered queries over the driver tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import EdgeFrame, Graph, NodeFrame
from graphloom.lang.lexer import QueryError
from graphloom.operators import community, fulltext, partition, vector, versions
from graphloom.session import Session
from graphloom.sources import files
from graphloom.sources.tables import OFFSETS, from_tables
from graphloom.storage import fresh_path

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
TEXTS: dict[str, str] = {}

LINK = (
    "link AS (SELECT c_custkey AS src, CASE j WHEN 0 THEN (c_custkey + 1) % n WHEN 1 THEN (c_custkey + 2) % n ELSE (7 * c_custkey + 1) % n END AS dst, j AS port, c_custkey * 3 + j AS eid"
    " FROM customer CROSS JOIN (SELECT count(*) AS n FROM customer) CROSS JOIN range(3) r(j))"
)
O, P, S, N, R = (OFFSETS[x] for x in ("Order", "Part", "Supplier", "Nation", "Region"))


#: Each label, how its nodes are counted, and its table.
LABELS = [("Customer", "count(*)", "customer"), ("Order", "count(*)", "orders"), ("Part", "count(*)", "part"), ("Supplier", "count(*)", "supplier"), ("Nation", "count(*)", "nation"), ("Region", "count(*)", "region"), ("User", "count(DISTINCT user_id)", "events"), ("Event", "count(*)", "events"), ("Doc", "count(*)", "documents"), ("Vec", "count(*)", "embeddings")]
#: The edges of all types: type, and the table or subquery with label and key of their source.
CHAIN = "(SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)"
EDGES = [("IN_REGION", "Nation", "n_nationkey", "nation"), ("IN_NATION", "Customer", "c_custkey", "customer"), ("BASED_IN", "Supplier", "s_suppkey", "supplier"), ("PLACED", "Customer", "o_custkey", "orders"), ("CONTAINS", "Order", "l_orderkey", "lineitem"), ("SUPPLIED_BY", "Order", "l_orderkey", "lineitem"), ("DID", "User", "user_id", "events"), ("LINK", "Customer", "c_custkey", "customer CROSS JOIN range(3)"), ("NEXT", "Order", "o_orderkey", f"{CHAIN} WHERE nx IS NOT NULL")]


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(from_tables(spark, sf_dir))


def text(name: str, query: str, sql: str | None, **params) -> None:
    """A query given as a statement of the language."""
    TEXTS[name] = query
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).run(query, **params)
    if sql:
        SQL[name] = sql


def plan(name: str, sql: str | None = None):
    """A query given as a function of (spark, sf_dir)."""

    def keep(f: Run) -> Run:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > $p RETURN c.c_mktsegment AS seg, count(o) AS n, round(sum(o.o_totalprice), 2) AS total ORDER BY total DESC LIMIT 5"
text("flagship", FLAGSHIP, "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY total DESC LIMIT 5", p=100000.0)

# scans
text("scan_all", "MATCH (n) RETURN label(n) AS label, count(*) AS n",
     " UNION ALL ".join(f"SELECT '{label}' AS label, {what} AS n FROM {table}" for label, what, table in LABELS))
text("scan_label", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation")
text("scan_property", "MATCH (p:Part) WHERE p.p_size = 7 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size = 7")
text("scan_id", "MATCH (c:Customer) WHERE id(c) = 42 RETURN id(c) AS id, c.c_name AS name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42")
text("scan_vector", "MATCH (v:Vec) WHERE vector_similarity(v.embedding, $q) > 0.1 RETURN v.vec_id AS id, round(vector_similarity(v.embedding, $q), 6) AS s",
     "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE[]), 6) AS s FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE[]) > 0.1",
     q=[1.0 if i % 2 == 0 else -1.0 for i in range(64)])
text("count_nodes", "MATCH (n:Customer) RETURN count(n) AS n", "SELECT count(*) AS n FROM customer")
text("count_edges", "MATCH ()-[r:CONTAINS]->() RETURN count(r) AS n", "SELECT count(*) AS n FROM lineitem")
text("inline_props", "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
text("end_label", "MATCH (o:Order)-->(p:Part {p_size: 1}) RETURN p.p_partkey AS k, count(*) AS n", "SELECT p_partkey AS k, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1 GROUP BY 1")

# predicates
text("filter_cmp", "MATCH (o:Order) WHERE o.o_totalprice >= 1000 AND o.o_totalprice < 50000 AND o.o_orderstatus <> 'P' RETURN count(*) AS n, round(avg(o.o_totalprice), 4) AS mean", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderstatus <> 'P'")
text("filter_bool", "MATCH (p:Part) WHERE NOT (p.p_size > 10 OR p.p_retailprice > 1500) AND p.p_brand <> 'Brand#11' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE NOT (p_size > 10 OR p_retailprice > 1500) AND p_brand <> 'Brand#11'")
text("null_semantics", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 WITH c, o.o_orderstatus AS s RETURN s = NULL AS missing, s < 'F' AS below, count(*) AS n",
     "SELECT s IS NOT DISTINCT FROM NULL AS missing, CASE WHEN s IS NULL THEN true ELSE s < 'F' END AS below, count(*) AS n FROM (SELECT o_orderstatus AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1, 2")
text("in_list", "MATCH (n:Nation) WHERE n.n_nationkey IN [1, 3, 5, 99] OR n.n_name IN $names RETURN n.n_nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (1, 3, 5, 99) OR n_name IN ('NATION_7', 'FRANCE')", names=["NATION_7", "FRANCE"])
text("string_predicates", "MATCH (c:Customer) WHERE c.c_name STARTS WITH 'C' AND c.c_name ENDS WITH '7' AND c.c_name CONTAINS '1' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE starts_with(c_name, 'C') AND ends_with(c_name, '7') AND contains(c_name, '1')")
text("is_null", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {o_orderstatus: 'P'}) WITH c, o WHERE o.o_orderkey IS NULL RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
text("case_simple", "MATCH (o:Order) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, count(*) AS n FROM orders GROUP BY 1")
text("case_searched", "MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'mid' END AS s", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' END AS s FROM part")
text("list_literal", "MATCH (r:Region) WITH r, [r.r_regionkey, 10, 20] AS l RETURN r.r_name AS name, size(l) AS n, l[0] AS first, last(l) AS tail", "SELECT r_name AS name, 3::BIGINT AS n, r_regionkey::BIGINT AS first, 20::BIGINT AS tail FROM region")
text("map_literal", "MATCH (r:Region) WITH {name: r.r_name, at: {x: r.r_regionkey}} AS m RETURN m.name AS name, m.at.x AS x", "SELECT r_name AS name, r_regionkey AS x FROM region")
text("param", "MATCH (c:Customer) WHERE c.c_acctbal > $low AND c.c_mktsegment = $seg RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'MACHINERY'", low=5000, seg="MACHINERY")
text("arith", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size * 2 + 1 AS a, p.p_size % 7 AS m, p.p_partkey / 3 AS d, round(p.p_retailprice / 3, 4) AS r, -p.p_size AS neg", "SELECT p_partkey AS k, p_size::BIGINT * 2 + 1 AS a, p_size::BIGINT % 7 AS m, p_partkey // 3 AS d, round(p_retailprice / 3, 4) AS r, -p_size AS neg FROM part")
text("unwind", "UNWIND [3, 1, 2] AS x MATCH (r:Region) WHERE r.r_regionkey = x RETURN x AS x, r.r_name AS name", "SELECT x::BIGINT AS x, r_name AS name FROM unnest([3, 1, 2]) u(x) JOIN region ON r_regionkey = x")
text("return_only", "RETURN 1 + 2 AS a, 'x' AS b, NULL = NULL AS c", "SELECT 3::BIGINT AS a, 'x' AS b, true AS c")
text("return_star", "MATCH (r:Region) WITH r.r_regionkey AS k, r.r_name AS name RETURN *", "SELECT r_regionkey AS k, r_name AS name FROM region")
text("nested_property", "MATCH (n:Nation) WITH {a: [n.n_nationkey, n.n_regionkey]} AS m RETURN m.a[1] AS region, count(*) AS n", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
text("with_chain", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WITH n, count(c) AS cs MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, sum(cs) AS customers", "SELECT r_name AS region, count(*)::DOUBLE AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
text("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.c_custkey AS k, count(*) AS n WHERE n > 12 RETURN k, n", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
text("with_limit_where", "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS s WHERE s = 3 ORDER BY k LIMIT 5 RETURN k", "SELECT p_partkey AS k FROM part WHERE p_size = 3 ORDER BY k LIMIT 5")
text("distinct", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT c.c_mktsegment AS seg, n.n_regionkey AS r", "SELECT DISTINCT c_mktsegment AS seg, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey")

# joins
text("expand_out", "MATCH (o:Order)-[r]->(x) WHERE id(o) = $o RETURN type(r) AS t, count(*) AS n", "SELECT t, count(*) AS n FROM (SELECT 'CONTAINS' AS t FROM lineitem WHERE l_orderkey = 5 UNION ALL SELECT 'SUPPLIED_BY' FROM lineitem WHERE l_orderkey = 5 UNION ALL SELECT 'NEXT' FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders) WHERE o_orderkey = 5 AND nx IS NOT NULL) GROUP BY 1", o=O + 5)
text("expand_in", "MATCH (n:Nation)<-[r]-(x) RETURN n.n_name AS nation, label(x) AS l, count(r) AS n", "SELECT n_name AS nation, 'Customer' AS l, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'Supplier', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
text("expand_both", "MATCH (a:Customer)-[:LINK]-(b:Customer) RETURN a.c_custkey AS k, count(*) AS n", f"WITH {LINK} SELECT k, count(*) AS n FROM (SELECT src AS k FROM link UNION ALL SELECT dst FROM link WHERE src <> dst) GROUP BY 1")
text("expand_typed", "MATCH (s:Supplier)<-[:SUPPLIED_BY]-(o:Order) RETURN s.s_name AS s, count(o) AS n", "SELECT s_name AS s, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
text("multi_type", "MATCH (o:Order)-[r:CONTAINS|SUPPLIED_BY]->(x) RETURN label(x) AS l, count(*) AS n", "SELECT 'Part' AS l, count(*) AS n FROM lineitem UNION ALL SELECT 'Supplier', count(*) FROM lineitem")
text("two_hop", "MATCH (c:Customer)-[:PLACED]->(:Order)-[:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
text("three_hop", "MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(o) AS n, round(sum(o.o_totalprice), 2) AS total", "SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
text("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, count(o) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1")
text("optional_unbound", "MATCH (r:Region) OPTIONAL MATCH (n:Nation)-[:IN_REGION]->(r) WHERE n.n_nationkey > r.r_regionkey + 20 RETURN r.r_regionkey AS r, coalesce(n.n_nationkey, -1) AS n", "SELECT r_regionkey AS r, coalesce(n_nationkey, -1)::BIGINT AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > r_regionkey + 20")
text("cross_product", "MATCH (a:Region), (b:Nation) RETURN a.r_regionkey AS a, b.n_nationkey AS b", "SELECT r_regionkey AS a, n_nationkey AS b FROM region, nation")
text("theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey RETURN a.n_nationkey AS a, b.n_nationkey AS b", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
text("shared_var", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS n, count(*) AS pairs", "SELECT n_name AS n, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
text("triangle", "MATCH (a:Customer)-[:LINK]->(b:Customer)-[:LINK]->(c:Customer), (a)-[:LINK]->(c) RETURN count(*) AS n", f"WITH {LINK} SELECT count(*) AS n FROM link x JOIN link y ON y.src = x.dst JOIN link z ON z.src = x.src AND z.dst = y.dst")
text("exists_semi", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
text("exists_anti", "MATCH (c:Customer) WHERE c.c_acctbal > 0 AND NOT EXISTS((c)-[:PLACED]->(:Order {o_orderstatus: 'P'})) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
text("port_filter", "MATCH (o:Order)-[r:CONTAINS:2]->(p:Part) RETURN p.p_brand AS b, count(*) AS n", "SELECT p_brand AS b, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 2 GROUP BY 1")
text("type_fn", "MATCH (c:Customer)-[r]->(x) RETURN type(r) AS t, count(*) AS n", "SELECT 'IN_NATION' AS t, count(*) AS n FROM customer UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'LINK', 3 * count(*) FROM customer")
text("edge_props", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.l_quantity > 45 RETURN p.p_brand AS b, round(sum(r.l_extendedprice * (1 - r.l_discount)), 2) AS revenue", "SELECT p_brand AS b, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 GROUP BY 1")
plan("ports_between", "SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1, 2")(
    lambda spark, d: _only(from_tables(spark, d), "CONTAINS").ports_between().select((F.col("src") - O).alias("o"), (F.col("dst") - P).alias("p"), F.size("ports").cast("bigint").alias("n"), F.aggregate("ports", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("s")))


def _only(g: Graph, *kinds: str) -> Graph:
    """The graph with those edge types only, and the node labels at their ends."""
    edges = {k: g.edges[k] for k in kinds}
    labels = {x for e in edges.values() for x in (e.src_label, e.dst_label)}
    return Graph(g.spark, {k: v for k, v in g.nodes.items() if k in labels}, edges)


# paths
VARLEN = f"WITH RECURSIVE {LINK}, p AS (SELECT c_custkey AS s, c_custkey AS e, [c_custkey] AS path, 0 AS h FROM customer WHERE {{start}} UNION ALL SELECT p.s, l.dst, list_append(p.path, l.dst), h + 1 FROM p JOIN link l ON l.src = p.e WHERE h < {{hops}} AND NOT list_contains(p.path, l.dst))"
text("varlen", "MATCH (a:Customer)-[:LINK*1..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, count(*) AS n", VARLEN.format(hops=3, start="true") + " SELECT s AS a, e AS b, count(*) AS n FROM p WHERE h >= 1 GROUP BY 1, 2")
text("varlen_path", "MATCH p = (a:Customer)-[r:LINK*2..3]->(b:Customer) RETURN id(a) AS a, id(b) AS b, length(p) AS len, p[1] AS via", VARLEN.format(hops=3, start="true") + " SELECT s AS a, e AS b, h::BIGINT AS len, path[2] AS via FROM p WHERE h >= 2")
text("varlen_in", "MATCH (a:Customer)<-[:LINK*1..2]-(b:Customer) WHERE id(a) = 7 RETURN id(b) AS b, count(*) AS n", f"WITH {LINK} SELECT b, count(*) AS n FROM (SELECT src AS b FROM link WHERE dst = 7 AND src <> 7 UNION ALL SELECT y.src FROM link x JOIN link y ON y.dst = x.src WHERE x.dst = 7 AND x.src <> 7 AND y.src <> 7 AND y.src <> x.src) GROUP BY 1")
text("varlen_unbounded", "MATCH (o:Order)-[:NEXT*3..]->(x:Order) WHERE id(o) = $o RETURN count(*) AS n",
     "WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, o_orderkey FROM orders) SELECT greatest(count(*) - 2, 0) AS n FROM s JOIN (SELECT o_custkey AS c, rn AS r FROM s WHERE o_orderkey = 5) ON c = s.o_custkey AND s.rn > r", o=O + 5)
text("shortest", "MATCH p = shortestPath((a:Customer)-[:LINK*..4]->(b:Customer)) RETURN id(a) AS a, id(b) AS b, length(p) AS len", VARLEN.format(hops=4, start="true") + " SELECT s AS a, e AS b, min(h)::BIGINT AS len FROM p WHERE h > 0 GROUP BY 1, 2")
text("shortest_all", "MATCH p = allShortestPaths((a:Customer)-[:LINK*..3]->(b:Customer)) RETURN id(a) AS a, id(b) AS b, length(p) AS len, count(*) AS paths",
     VARLEN.format(hops=3, start="true") + ", d AS (SELECT DISTINCT s, e, path, h FROM p WHERE h > 0) SELECT s AS a, e AS b, h::BIGINT AS len, count(*) AS paths FROM d WHERE h = (SELECT min(h) FROM d x WHERE x.s = d.s AND x.e = d.e) GROUP BY 1, 2, 3")
text("shortest_target", "MATCH p = SHORTEST PATH (a:Customer)-[:LINK*..6]->(b:Customer) WHERE id(a) = 0 AND id(b) = 20 RETURN length(p) AS len", VARLEN.format(hops=6, start="c_custkey = 0") + " SELECT min(h)::BIGINT AS len FROM p WHERE e = 20 AND h > 0 HAVING min(h) IS NOT NULL")
text("fixed_path", "MATCH p = (r:Region)<-[:IN_REGION]-(n:Nation) RETURN length(p) AS len, count(*) AS n", "SELECT 1::BIGINT AS len, count(*) AS n FROM nation")


def _road(spark: SparkSession, d: str) -> Session:
    """The parts as a road, each leading to the next, cut after every 75: paths of up to 74 edges."""
    part = spark.read.parquet(f"{d}/part.parquet")
    steps = part.filter("p_partkey % 75 <> 74").join(part.select(F.col("p_partkey").alias("next")), F.col("p_partkey") + 1 == F.col("next"))
    nodes = NodeFrame(part.select(F.col("p_partkey").alias("id"), "p_partkey"))
    return Session(Graph(spark, {"Stop": nodes}, {"ROAD": EdgeFrame(steps.select(F.col("p_partkey").alias("eid"), F.col("p_partkey").alias("src"), F.col("next").alias("dst"), F.lit(0).alias("port")), "Stop", "Stop")}))


ROAD = "WITH n AS (SELECT p_partkey AS k FROM part) SELECT a.k AS a, b.k AS b{} FROM n a JOIN n b ON b.k > a.k AND b.k // 75 = a.k // 75 WHERE a.k % 75 = 0"
plan("varlen_long", ROAD.format(", b.k - a.k AS len"))(lambda s, d: _road(s, d).run("MATCH p = (a:Stop)-[:ROAD*]->(b:Stop) WHERE a.p_partkey % 75 = 0 RETURN id(a) AS a, id(b) AS b, length(p) AS len"))
plan("shortest_long", "SELECT 75::BIGINT AS a, 149::BIGINT AS b, 74::BIGINT AS len")(lambda s, d: _road(s, d).run("MATCH p = shortestPath((a:Stop)-[:ROAD*]->(b:Stop)) WHERE id(a) = 75 AND id(b) = 149 RETURN id(a) AS a, id(b) AS b, length(p) AS len"))
plan("has_edge", f"WITH {LINK} SELECT count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM link WHERE src = a.c_custkey AND dst = (a.c_custkey * 7 + 1) % n)) AS forth, count(*) FILTER (EXISTS (SELECT 1 FROM link WHERE dst = a.c_custkey AND src = (a.c_custkey * 7 + 1) % n)) AS back FROM customer a, (SELECT count(*) AS n FROM customer)")(lambda s, d: _has_edge(s, d))


def _has_edge(spark: SparkSession, d: str) -> DataFrame:
    """For every customer k and 7 k + 1, whether there is an edge there, and back."""
    g, c = _only(from_tables(spark, d), "LINK"), spark.read.parquet(f"{d}/customer.parquet")
    ends = c.crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).select(F.col("c_custkey").alias("src"), F.pmod(7 * F.col("c_custkey") + 1, F.col("n")).alias("dst"))
    back = g.has_edge(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "LINK")
    yes = lambda df, name: df.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("found"), 1)).alias(name))
    return yes(g.has_edge(ends), "forth").crossJoin(yes(back, "back").drop("pairs"))


DEG = f"WITH {LINK}"
plan("degree", DEG + " SELECT c_custkey AS id, (SELECT count(*) FROM link WHERE src = c_custkey) AS out_degree, (SELECT count(*) FROM link WHERE dst = c_custkey) AS in_degree FROM customer")(lambda spark, d: _only(from_tables(spark, d), "LINK").degrees())
plan("neighbours", DEG + " SELECT src, list_aggregate(list_sort(list(DISTINCT dst)), 'string_agg', ',') AS targets FROM link GROUP BY 1")(lambda spark, d: _only(from_tables(spark, d), "LINK").neighbours().select("src", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets")))
plan("bfs_step", DEG + " SELECT dst AS id, sum(src % 5 + 1)::BIGINT AS x FROM link GROUP BY 1")(lambda spark, d: _only(from_tables(spark, d), "LINK").bfs_step(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 + 1).alias("x"))))
plan("csr_stats", "SELECT k AS name, v AS value FROM (SELECT count(*)::DOUBLE AS n FROM customer), (SELECT 3.0::DOUBLE AS d), LATERAL (VALUES ('nodes', n), ('edges', n * d), ('max_degree', d), ('min_degree', d), ('avg_degree', d)) t(k, v)")(lambda spark, d: _only(from_tables(spark, d), "LINK").statistics().filter("kind = 'graph'").select("name", "value"))
plan("validate", "SELECT 'none' AS problem, 0::BIGINT AS n WHERE false")(lambda spark, d: from_tables(spark, d).validate().groupBy("problem").agg(F.count("*").alias("n")))
plan("validate_broken", f"WITH {LINK}, gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) SELECT 'no src' AS problem, 'PLACED' AS name, count(*) AS n FROM orders JOIN gone ON k = o_custkey UNION ALL SELECT 'no src', 'IN_NATION', count(*) FROM gone UNION ALL SELECT 'no src', 'LINK', count(*) FROM link JOIN gone ON k = src UNION ALL SELECT 'no dst', 'LINK', count(*) FROM link JOIN gone ON k = dst UNION ALL SELECT 'repeated id', 'Region', count(*) FROM region")(lambda spark, d: _broken(from_tables(spark, d)).validate().groupBy("problem", "name").agg(F.count("*").alias("n")))


def _broken(g: Graph) -> Graph:
    """The graph after customers in debt have gone without their edges, and with every region twice."""
    customers, regions = g.nodes["Customer"], g.nodes["Region"]
    g = g.with_nodes("Customer", NodeFrame(customers.df.filter("NOT c_acctbal < 0"), customers.key, customers.offset))
    return g.with_nodes("Region", NodeFrame(regions.df.unionByName(regions.df), regions.key, regions.offset))

# aggregation, order, sets
text("group_implicit", "MATCH (o:Order) RETURN o.o_orderpriority AS p, o.o_orderstatus AS s, count(*) AS n", "SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2")
text("group_explicit", "MATCH (o:Order) RETURN count(*) AS n, round(max(o.o_totalprice), 2) AS m GROUP BY o.o_orderstatus", "SELECT count(*) AS n, round(max(o_totalprice), 2) AS m FROM orders GROUP BY o_orderstatus")
text("global_agg_empty", "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(*) AS n, sum(c.c_acctbal) AS s", "SELECT count(*) AS n, sum(c_acctbal) AS s FROM customer WHERE c_custkey < 0")
text("count_distinct", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, count(DISTINCT o.o_orderpriority) AS p, count(DISTINCT c) AS c", "SELECT c_mktsegment AS seg, count(DISTINCT o_orderpriority) AS p, count(DISTINCT c_custkey) AS c FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
text("sum_avg", "MATCH (p:Part) RETURN p.p_brand AS b, sum(p.p_size) AS s, round(avg(p.p_size), 6) AS a, sum(DISTINCT p.p_size) AS d", "SELECT p_brand AS b, sum(p_size)::DOUBLE AS s, round(avg(p_size), 6) AS a, sum(DISTINCT p_size)::DOUBLE AS d FROM part GROUP BY 1")
text("min_max", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, min(c.c_name) AS first", "SELECT c_mktsegment AS seg, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY 1")
text("collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.r_name AS region, collect(n.n_nationkey) AS ks RETURN region, size(ks) AS n, head(ks) AS least, last(ks) AS most", "SELECT r_name AS region, count(*) AS n, min(n_nationkey) AS least, max(n_nationkey) AS most FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
text("agg_expr", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, count(o) * 2 + 1 AS n, count(DISTINCT c) > 100 AS many, size(collect(DISTINCT o.o_orderstatus)) AS s", "SELECT c_mktsegment AS seg, count(*) * 2 + 1 AS n, count(DISTINCT c_custkey) > 100 AS many, count(DISTINCT o_orderstatus) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
text("order_multi", "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, c.c_custkey AS k ORDER BY c.c_mktsegment DESC, c.c_acctbal ASC, k LIMIT 50", "SELECT c_mktsegment AS seg, c_custkey AS k FROM customer ORDER BY c_mktsegment DESC, c_acctbal, k LIMIT 50")
text("skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, k SKIP 10 LIMIT 20", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, k LIMIT 20 OFFSET 10")
text("topk", "MATCH (p:Part)<-[r:CONTAINS]-(o:Order) RETURN p.p_partkey AS k, count(r) AS n ORDER BY count(r) DESC, k LIMIT 10", "SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, k LIMIT 10")
text("union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")

# scalar functions
text("scalar_string", "MATCH (c:Customer) RETURN c.c_custkey AS k, toLower(c.c_name) AS a, toUpper(c.c_mktsegment) AS b, substring(c.c_name, 1, 4) AS c, left(c.c_name, 3) AS d, right(c.c_name, 3) AS e, replace(c.c_name, 'u', '_') AS f, trim('  x ') AS g, split(c.c_name, 'm')[0] AS h, size(c.c_name) AS i, toLower(c.c_custkey) IS NULL AS j",
     "SELECT c_custkey AS k, lower(c_name) AS a, upper(c_mktsegment) AS b, substr(c_name, 2, 4) AS c, left(c_name, 3) AS d, right(c_name, 3) AS e, replace(c_name, 'u', '_') AS f, 'x' AS g, string_split(c_name, 'm')[1] AS h, length(c_name) AS i, true AS j FROM customer")
text("scalar_convert", "MATCH (p:Part) RETURN p.p_partkey AS k, toString(p.p_size) AS a, toInteger(p.p_retailprice) AS b, toInteger('17') AS c, toInteger(' 7') IS NULL AS d, toFloat('2.5') AS e, toBoolean('true') AS f, toBoolean('yes') IS NULL AS g, coalesce(NULL, p.p_brand) AS h",
     "SELECT p_partkey AS k, p_size::VARCHAR AS a, trunc(p_retailprice)::BIGINT AS b, 17::BIGINT AS c, true AS d, 2.5::DOUBLE AS e, true AS f, true AS g, p_brand AS h FROM part")
text("scalar_temporal", "MATCH (o:Order) WHERE o.o_orderdate >= datetime('1996-01-01T00:00:00') AND o.o_orderdate < datetime('1996-02-01') RETURN count(*) AS n, toString(date('1996-01-15')) AS d, date('oops') IS NULL AS bad", "SELECT count(*) AS n, '1996-01-15' AS d, true AS bad FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
text("scalar_math", "MATCH (p:Part) RETURN p.p_partkey AS k, abs(p.p_size - 25) AS a, ceil(p.p_retailprice) AS b, floor(p.p_retailprice) AS c, round(sqrt(p.p_size), 6) AS d, sign(p.p_size - 25) AS e, round(log(p.p_retailprice), 6) AS f, round(log10(p.p_retailprice), 6) AS g, round(exp(p.p_size / 50.0), 6) AS h",
     "SELECT p_partkey AS k, abs(p_size::BIGINT - 25) AS a, ceil(p_retailprice)::BIGINT AS b, floor(p_retailprice)::BIGINT AS c, round(sqrt(p_size), 6) AS d, sign(p_size - 25)::DOUBLE AS e, round(ln(p_retailprice), 6) AS f, round(log10(p_retailprice), 6) AS g, round(exp(p_size / 50.0), 6) AS h FROM part")
text("scalar_list", "MATCH (n:Nation) WITH range(0, n.n_regionkey) AS l RETURN size(l) AS s, head(l) AS h, last(l) AS t, l[9] IS NULL AS beyond, count(*) AS n", "SELECT (n_regionkey + 1)::BIGINT AS s, 0::BIGINT AS h, n_regionkey::BIGINT AS t, true AS beyond, count(*) AS n FROM nation GROUP BY n_regionkey")
text("labels_fn", "MATCH (n) WHERE label(n) IN ['Nation', 'Region'] RETURN labels(n)[0] AS l, count(*) AS n", "SELECT 'Nation' AS l, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
text("rand_fn", "MATCH (r:Region) RETURN r.r_regionkey AS k, rand() >= 0 AS ok", "SELECT r_regionkey AS k, true AS ok FROM region")
text("comments_keywords", "MATCH (match:Region) // a variable like a keyword\nRETURN match.r_name AS order /* and a column */ ;", "SELECT r_name AS order FROM region")

# vectors
Q = [((i * 37) % 64 - 32) / 32 for i in range(64)]
QSQL = "list_transform(range(64), lambda i: ((i * 37) % 64 - 32) / 32.0)::DOUBLE[]"
V = "embedding::DOUBLE[]"
#: The rows that searches against all rows take as their queries.
ASKING = "id % 50 = 0"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


plan("cosine_knn", f"SELECT vec_id AS id, round(list_cosine_similarity({V}, {QSQL}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity({V}, {QSQL}) DESC, vec_id LIMIT 10")(lambda s, d: _round(vector.knn(_vectors(s, d), Q, 10), "similarity"))
plan("euclid_knn", f"SELECT vec_id AS id, round(-list_distance({V}, {QSQL}), 6) AS similarity FROM embeddings ORDER BY list_distance({V}, {QSQL}), vec_id LIMIT 10")(lambda s, d: _round(vector.knn(_vectors(s, d), Q, 10, "euclidean"), "similarity"))
plan("dot_knn", f"SELECT vec_id AS id, round(list_inner_product({V}, {QSQL}), 6) AS similarity FROM embeddings ORDER BY list_inner_product({V}, {QSQL}) DESC, vec_id LIMIT 10")(lambda s, d: _round(vector.knn(_vectors(s, d), Q, 10, "dot"), "similarity"))
plan("knn_filtered", f"SELECT vec_id AS id, round(list_cosine_similarity({V}, {QSQL}), 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity({V}, {QSQL}) DESC, vec_id LIMIT 5")(lambda s, d: _round(vector.knn(_vectors(s, d).filter("label = 3"), Q, 5), "similarity"))
plan("knn_sharded", f"SELECT vec_id AS id, vec_id % 4 AS shard, round(list_cosine_similarity({V}, {QSQL}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity({V}, {QSQL}) DESC, vec_id LIMIT 20")(lambda s, d: _round(vector.sharded_knn(_vectors(s, d), Q, 20, 4), "similarity"))
plan("similar_nodes", f"SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.{V}, b.{V}), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.{V}, b.{V}) DESC, b.vec_id) <= 10")(lambda s, d: _round(vector.knn_join(_vectors(s, d).filter(ASKING), _vectors(s, d), 10), "similarity"))
text("order_by_similarity", "MATCH (v:Vec) RETURN v.vec_id AS id ORDER BY vector_similarity(v.embedding, $q) DESC, id LIMIT 5", f"SELECT vec_id AS id FROM embeddings ORDER BY list_cosine_similarity({V}, {QSQL}) DESC, vec_id LIMIT 5", q=Q)
text("call_search", "CALL graph.search($q, 'cosine', 5) YIELD node AS id", f"SELECT vec_id + {OFFSETS['Vec']} AS id FROM embeddings ORDER BY list_cosine_similarity({V}, {QSQL}) DESC, vec_id LIMIT 5", q=Q)
@plan("vector_init", f"SELECT 64::BIGINT AS dimension, vec_id + {OFFSETS['Vec']} AS nearest, true AS refused FROM embeddings ORDER BY list_cosine_similarity({V}, {QSQL}) DESC, vec_id LIMIT 1")
def _vector_init(spark: SparkSession, d: str) -> DataFrame:
    """The dimension is set; searches and writes of another one are refused."""
    s = session(spark, d)
    dimension = s.run("CALL graph.vectorInit(64)")
    refused = 0
    for statement, params in (("CALL graph.search($q, 'cosine', 1)", {"q": [1.0, 2.0]}), ("CREATE (v:Vec {embedding: [1.0, 2.0]})", {})):
        try:
            s.run(statement, **params)
        except QueryError:
            refused += 1
    return dimension.crossJoin(s.run("CALL graph.search($q, 'cosine', 1) YIELD node AS nearest", q=Q)).withColumn("refused", F.lit(refused == 2))
plan("quant_int8", f"WITH e AS (SELECT vec_id, {V} AS v, list_min({V}) AS lo, list_max({V}) AS hi FROM embeddings), c AS (SELECT vec_id, lo, hi, list_transform(v, lambda x: floor((x - lo) / ((hi - lo) / 255) + 0.5)) AS codes FROM e) SELECT vec_id AS id, round(lo, 6) AS low, round(hi, 6) AS high, list_sum(codes)::BIGINT AS total FROM c")(
    lambda s, d: _vectors(s, d).select("id", vector.quantise(F.col("v")).alias("q")).select("id", F.round("q.low", 6).alias("low"), F.round("q.high", 6).alias("high"), F.aggregate("q.codes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")))
plan("quant_error", f"WITH e AS (SELECT vec_id, {V} AS v, list_min({V}) AS lo, list_max({V}) AS hi FROM embeddings) SELECT vec_id AS id, round(list_max(list_transform(v, lambda x: abs(x - (lo + floor((x - lo) / ((hi - lo) / 255) + 0.5) * ((hi - lo) / 255))))), 6) AS error FROM e")(
    lambda s, d: _vectors(s, d).select("id", F.col("v").cast("array<double>").alias("v"), vector.quantise(F.col("v")).alias("q")).select("id", F.round(F.array_max(F.zip_with("v", vector.dequantise(F.col("q")), lambda a, b: F.abs(a - b))), 6).alias("error")))
plan("quant_asymmetric", f"WITH e AS (SELECT vec_id, {V} AS v, list_min({V}) AS lo, list_max({V}) AS hi FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: lo + floor((x - lo) / ((hi - lo) / 255) + 0.5) * ((hi - lo) / 255)) AS w FROM e) SELECT vec_id AS id, round(list_distance(w, {QSQL}), 6) AS distance FROM c")(
    lambda s, d: _vectors(s, d).select("id", F.round(-vector.similarity("l2", vector.dequantise(vector.quantise(F.col("v"))), F.array(*[F.lit(float(x)) for x in Q])), 6).alias("distance")))
plan("quant_binary", f"WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS s FROM embeddings), h AS (SELECT a.vec_id AS query, b.vec_id AS id, list_sum(list_transform(list_zip(a.s, b.s), lambda t: CASE WHEN t[1] <> t[2] THEN 1 ELSE 0 END))::INT AS hamming FROM b a JOIN b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id) SELECT query, id, hamming FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY hamming, id) <= 10")(
    lambda s, d: vector.knn_join(_vectors(s, d).filter(ASKING), _vectors(s, d), 10, "hamming").select("query", "id", (-F.col("similarity")).cast("int").alias("hamming")))
plan("quant_bits", "SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings")(lambda s, d: _vectors(s, d).select("id", F.array_join(vector.signs(F.col("v")).cast("array<string>"), "").alias("bits")))
plan("vector_memory", "SELECT count(*) AS vectors, 64::BIGINT AS dimension, (count(*) * 256)::BIGINT AS float_bytes, (count(*) * 72)::BIGINT AS int8_bytes, (count(*) * 8)::BIGINT AS binary_bytes FROM embeddings")(lambda s, d: vector.memory(_vectors(s, d)))


@plan("ivf_search", SQL["similar_nodes"])
def _ivf(spark: SparkSession, d: str) -> DataFrame:
    model, filed = vector.ivf(_vectors(spark, d), 8)
    return _round(vector.ivf_join(model, filed, 10, F.expr(ASKING)), "similarity")


# text
TOK = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def _bm25_sql(words: list[str], where: str, k: int) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    return f"WITH t AS (SELECT doc_id AS id, {TOK} AS t FROM documents), c AS (SELECT id, t, len(t) AS dl, {tf} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c) SELECT id, round({score}, 6) AS score FROM c, s WHERE {where} ORDER BY {score} DESC, id LIMIT {k}"


plan("bm25", _bm25_sql(["nature", "the", "und"], "tf0 + tf1 + tf2 > 0", 20))(lambda s, d: _round(fulltext.search(_texts(s, d), "nature the und", 20), "score"))
plan("bm25_boolean", _bm25_sql(["and", "the"], "tf0 > 0 AND tf1 > 0 AND NOT list_contains(t, 'idiot')", 15))(lambda s, d: _round(fulltext.search(_texts(s, d), "the AND and -idiot", 15), "score"))
plan("phrase", "WITH t AS (SELECT doc_id AS id, ' ' || array_to_string(" + TOK + ", ' ') || ' ' AS t FROM documents) SELECT id FROM t WHERE contains(t, ' of the ')")(lambda s, d: fulltext.search(_texts(s, d), '"of the"', None).select("id"))
plan("fuzzy", "WITH t AS (SELECT doc_id AS id, unnest(" + TOK + ") AS t FROM documents), w AS (SELECT id, 1.0::DOUBLE / (1 + damerau_levenshtein(t, 'thers')) AS w FROM t WHERE damerau_levenshtein(t, 'thers') <= 1) SELECT id, round(sum(w), 6) AS score FROM w GROUP BY 1 ORDER BY sum(w) DESC, id LIMIT 20")(lambda s, d: _round(fulltext.fuzzy(_texts(s, d), "thers", 20, 1), "score"))
# the engine's code: H and W are passed over, other letters without a code part equal ones
SOUND = "left(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(upper(t), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202'), '7', '', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), 2), '0', '', 'g') || '000', 3)"
plan("soundex", "WITH t AS (SELECT doc_id AS id, unnest(" + TOK + f") AS t FROM documents) SELECT id, count(*) AS hits FROM t WHERE starts_with(t, 't') AND {SOUND} = '600' GROUP BY 1")(lambda s, d: fulltext.phonetic(_texts(s, d), "there"))
plan("stop_words", "SELECT 14::BIGINT AS languages, 1::BIGINT AS has_the")(lambda s, d: s.createDataFrame([(sum(bool(fulltext.stop_words(x)) for x in fulltext.LANGUAGES), int("the" in fulltext.stop_words("english")))], "languages bigint, has_the bigint"))
plan("naive_search", "SELECT id, score FROM (SELECT p_partkey AS id, round(CASE WHEN contains(lower(p_name), 'blue bolt') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(p_type), 'blue bolt') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(p_name), 'blue') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'blue') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(p_name), 'bolt') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'bolt') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM part) WHERE score > 0 ORDER BY score DESC, id LIMIT 200")(
    lambda s, d: fulltext.naive(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("body")), "Blue Bolt", 200))
plan("postings", "WITH t AS (SELECT doc_id AS id, unnest(" + TOK + ") AS term FROM documents) SELECT term, count(DISTINCT id) AS docs, count(*) AS n FROM t GROUP BY 1")(lambda s, d: fulltext.build_index(_texts(s, d)).postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("n")))


@plan("fulltext_call", _bm25_sql(["the"], "tf0 > 0", 10).replace("SELECT id, round", f"SELECT id + {OFFSETS['Doc']} AS node, round"))
def _ft_call(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d)
    s.run("CALL graph.fulltext.createIndex('docs', 'Doc', ['text'])")
    return _round(s.run("CALL graph.fulltext.query('docs', 'the', 10) YIELD node, score"), "score")


@plan("fulltext_phrase", "WITH t AS (SELECT doc_id AS id, ' ' || array_to_string(" + TOK + ", ' ') || ' ' AS t FROM documents) SELECT id + " + str(OFFSETS["Doc"]) + " AS node FROM t WHERE contains(t, ' of the ') AND NOT contains(t, ' and ')")
def _ft_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A phrase by the positions of the stored index, without documents of a word."""
    s = session(spark, d)
    s.run("CALL graph.fulltext.createIndex('docs', 'Doc', ['text'])")
    return s.run("CALL graph.fulltext.query('docs', '+\"of the\" -and', 1000000) YIELD node")


@plan("fulltext_fuzzy", "WITH t AS (SELECT doc_id AS id, unnest(" + TOK + ") AS t FROM documents), w AS (SELECT id, 1.0::DOUBLE / (1 + damerau_levenshtein(t, 'hte')) AS w FROM t WHERE damerau_levenshtein(t, 'hte') <= 1) SELECT id + " + str(OFFSETS["Doc"]) + " AS node, round(sum(w), 6) AS score FROM w GROUP BY 1 ORDER BY sum(w) DESC, node LIMIT 20")
def _ft_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Swapped letters are one edit; distances are taken over the vocabulary."""
    s = session(spark, d)
    s.run("CALL graph.fulltext.createIndex('docs', 'Doc', ['text'])")
    return _round(s.run("CALL graph.fulltext.fuzzyQuery('docs', 'hte', 20, 1)"), "score")


@plan("fulltext_phonetic", "WITH t AS (SELECT doc_id AS id, unnest(" + TOK + f") AS t FROM documents) SELECT id + {OFFSETS['Doc']} AS node FROM t WHERE starts_with(t, 't') AND {SOUND} = '600' AND id <> 3 GROUP BY 1")
def _ft_phonetic(spark: SparkSession, d: str) -> DataFrame:
    """Words that sound like the query's, in all documents but one that was taken out of the index."""
    s = session(spark, d)
    s.run("CALL graph.fulltext.createIndex('docs', 'Doc', ['text'], NULL, true)")
    s.run("CALL graph.fulltext.deleteDocument('docs', $doc)", doc=OFFSETS["Doc"] + 3)
    return s.run("CALL graph.fulltext.query('docs', 'there', 1000000) YIELD node")


@plan("fulltext_stems")
def _ft_stems(spark: SparkSession, d: str) -> DataFrame:
    """English: without stop words, by stems."""
    s = session(spark, d)
    s.run("CALL graph.fulltext.createIndex('docs', 'Doc', ['text'], 'english')")
    return _round(s.run("CALL graph.fulltext.query('docs', 'the licensed benefits', 50)"), "score")


@plan("fulltext_indexes", "SELECT 'a' AS name, 'Doc' AS label, 'text' AS properties, 'english' AS language, false AS phonetic")
def _ft_list(spark: SparkSession, d: str) -> DataFrame:
    s = session(spark, d)
    s.run("CALL graph.fulltext.createIndex('a', 'Doc', ['text'], 'english')")
    s.run("CALL graph.fulltext.createIndex('b', 'Part', 'p_name')")
    s.run("CALL graph.fulltext.dropIndex('b')")
    return s.run("CALL graph.fulltext.indexes()")


# writes: each query returns the state after them
def after(name: str, sql: str, statements: list[str], ask: str, **params) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = session(spark, d)
        for statement in statements:
            s.run(statement, **params)
        return s.run(ask, **params)

    QUERIES[name], SQL[name], TEXTS[name] = run, sql, "; ".join([*statements, ask])


after("create_nodes", "SELECT r_regionkey::BIGINT AS k, r_name AS name FROM region UNION ALL SELECT 5, 'ATLANTIS'", ["CREATE (r:Region {r_name: 'ATLANTIS'})"], "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name")
after("create_path", "SELECT 'X' AS n, 'Y' AS r", ["CREATE (n:Nation {n_name: 'X'})-[:IN_REGION]->(r:Region {r_name: 'Y'})"], "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'Y' RETURN n.n_name AS n, r.r_name AS r")
after("match_create", "SELECT c_custkey AS k, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9500", ["MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.c_acctbal > 9500 CREATE (n)-[:HOSTS {since: 2024}]->(c)"], "MATCH (n:Nation)-[h:HOSTS]->(c:Customer) WHERE h.since = 2024 RETURN c.c_custkey AS k, n.n_name AS n")
after("set_prop", "SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 'vip' END AS tier FROM customer", ["MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' SET c.c_acctbal = c.c_acctbal * 2, c.tier = 'vip'"], "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal AS b, c.tier AS tier")
after("remove_prop", "SELECT n_nationkey AS k, CASE WHEN n_regionkey <> 1 THEN n_name END AS name FROM nation", ["MATCH (n:Nation) WHERE n.n_regionkey = 1 REMOVE n.n_name"], "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")
after("delete_detach", "SELECT n_nationkey AS n, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY 1", ["MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_regionkey = 0 DETACH DELETE n"], "MATCH (n:Nation) OPTIONAL MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.n_nationkey AS n, count(c) AS c")
after("delete_rel", f"WITH {LINK} SELECT count(*) AS n FROM link WHERE port <> 2", ["MATCH (a:Customer)-[r:LINK:2]->(b:Customer) DELETE r"], "MATCH (a:Customer)-[r:LINK]->(b:Customer) RETURN count(r) AS n")
after("merge_node", "SELECT r_name AS name, count(*) AS n FROM region GROUP BY 1 UNION ALL SELECT 'LEMURIA', 1", ["UNWIND ['ASIA', 'LEMURIA', 'LEMURIA'] AS x MERGE (r:Region {r_name: x})", "MERGE (r:Region {r_name: 'LEMURIA'})"], "MATCH (r:Region) RETURN r.r_name AS name, count(*) AS n")
after("merge_edge", "SELECT count(*) + (SELECT count(*) FROM nation WHERE n_regionkey <> 2) AS n FROM nation", ["MATCH (n:Nation), (r:Region) WHERE r.r_regionkey = 2 MERGE (n)-[:IN_REGION]->(r)"], "MATCH (n:Nation)-[x:IN_REGION]->(r:Region) RETURN count(x) AS n")
after("merge_on_set", "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN 'seen' END AS state FROM region UNION ALL SELECT 'MU', 'new'", ["UNWIND ['ASIA', 'MU'] AS x MERGE (r:Region {r_name: x}) ON CREATE SET r.state = 'new' ON MATCH SET r.state = 'seen'"], "MATCH (r:Region) RETURN r.r_name AS name, r.state AS state")
after("tx_commit", "SELECT count(*) + 2 AS n FROM region", ["BEGIN", "CREATE (r:Region {r_name: 'A'})", "CREATE (r:Region {r_name: 'B'})", "COMMIT"], "MATCH (r:Region) RETURN count(*) AS n")
after("tx_rollback", "SELECT count(*) AS n FROM region", ["BEGIN", "CREATE (r:Region {r_name: 'A'})", "ROLLBACK"], "MATCH (r:Region) RETURN count(*) AS n")
plan("unique_violations", "SELECT c_nationkey AS value, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")(lambda s, d: from_tables(s, d).unique_violations("Customer", "c_nationkey"))


def _timed(spark: SparkSession, d: str) -> Session:
    from datetime import datetime

    s = session(spark, d)
    s.record(datetime(2026, 1, 15, 10))
    s.clock = lambda: datetime(2026, 1, 15, 11)
    s.run("CREATE (r:Region {r_name: 'LATER'})")
    s.clock = lambda: datetime(2026, 1, 15, 12)
    s.run("MATCH (r:Region) WHERE r.r_name = 'ASIA' SET r.r_name = 'ASIA2'")
    return s


plan("at_time", "SELECT r_name AS name FROM region UNION ALL SELECT 'LATER'")(lambda s, d: _timed(s, d).run("MATCH (r:Region) AT TIME '2026-01-15T11:30:00' RETURN r.r_name AS name"))
plan("at_time_last", "SELECT r_name AS name FROM region")(lambda s, d: _timed(s, d).run("MATCH (r:Region) RETURN r.r_name AS name AT TIMESTAMP datetime('2026-01-15T10:00:00')"))
@plan("flashback", "SELECT 2::BIGINT AS tx_id, r_name AS name FROM region UNION ALL SELECT 2, 'LATER'")
def _flashback(spark: SparkSession, d: str) -> DataFrame:
    """The graph is again what it was, before the last change."""
    s = _timed(spark, d)
    return s.run("FLASHBACK TO '2026-01-15T11:59:00'").crossJoin(s.run("MATCH (r:Region) RETURN r.r_name AS name"))


@plan("log_recover", "SELECT n_name AS name, n_regionkey::BIGINT + 100 AS region FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'NEW', NULL")
def _log_recover(spark: SparkSession, d: str) -> DataFrame:
    """Statements write a log; the graph is read back from it alone."""
    s = Session(Graph(spark), log=fresh_path(spark, "change-log"))
    s.load({"Nation": spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))})
    s.run("MATCH (n:Nation) SET n.region = n.region + 100")
    s.run("CREATE (n:Nation {name: 'NEW'})")
    s.run("MATCH (n:Nation) WHERE id(n) = 3 DETACH DELETE n")
    back = versions.recover(spark.read.schema(versions.LOG_SCHEMA).parquet(s.log), {"Nation": "name string, region bigint"})
    return Session(back).run("MATCH (n:Nation) RETURN n.name AS name, n.region AS region")


@plan("constraint", "SELECT true AS refused, count(*) AS n FROM customer UNION ALL SELECT false, count(*) + 1 FROM customer")
def _constraint(spark: SparkSession, d: str) -> DataFrame:
    """A name that is there is refused while the constraint stands, and the graph stays as it was; then it is taken."""
    s, rows = session(spark, d), []
    s.run("CALL graph.constraint.create('names', 'Customer', 'c_name')")
    taken = s.run("MATCH (c:Customer) WHERE c.c_custkey = 0 RETURN c.c_name AS name").first()[0]
    for _ in range(2):
        try:
            s.run("CREATE (c:Customer {c_name: $name})", name=taken)
            refused = False
        except QueryError:
            refused = True
            s.run("CALL graph.constraint.drop('names')")
        rows.append(s.run("MATCH (c:Customer) RETURN count(*) AS n").select(F.lit(refused).alias("refused"), "n"))
    return rows[0].unionByName(rows[1])


@plan("bulk_load", "SELECT p_brand AS brand, count(*) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _bulk_load(spark: SparkSession, d: str) -> DataFrame:
    """Whole tables become nodes and edges of a running session in one version."""
    s = Session(Graph(spark))
    part, line = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    ids = {"P": part.select(F.col("p_partkey").alias("id"), "p_brand"), "S": spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 10**12).alias("id"), "s_name")}
    s.load(ids, {"SOLD": line.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10**12).alias("dst"), "l_quantity")})
    return s.run("MATCH (p:P)-[r:SOLD]->(x:S) RETURN p.p_brand AS brand, count(r) AS lines")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a change log: an hour is a transaction, every third hour never commits, errors delete the user."""
    e = spark.read.parquet(f"{d}/events.parquet")
    tx = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("bigint")
    changes = e.select(tx.alias("tx_id"), "ts", F.when(F.col("event_type") == "error", "delete_node").when(F.col("event_type") == "signup", "create_node").otherwise("set").alias("op"), F.col("user_id").alias("id"), F.lit("User").alias("label"), F.col("event_type").alias("key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("value"), F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("dst"))
    commits = changes.groupBy("tx_id").agg(F.max("ts").alias("ts")).filter("tx_id % 3 <> 0").select("tx_id", "ts", F.lit("commit").alias("op"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", "bigint"), ("label", "string"), ("key", "string"), ("value", "string"), ("src", "bigint"), ("dst", "bigint"))])
    return changes.unionByName(commits)


LOG = "l AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS tx, user_id AS id, event_type AS t, lpad(event_id::VARCHAR, 12, '0') AS v FROM events), c AS (SELECT * FROM l WHERE tx % 3 <> 0)"
NODES = "n AS (SELECT id FROM (SELECT id, max((tx, CASE t WHEN 'error' THEN 'delete_node' ELSE 'create_node' END)) AS m FROM c WHERE t IN ('error', 'signup') {} GROUP BY 1) WHERE m[2] = 'create_node')"
plan("log_replay", f"WITH {LOG}, {NODES.format('')} SELECT id, t AS key, max((tx, v))[2] AS value FROM c WHERE t NOT IN ('error', 'signup') AND id IN (SELECT id FROM n) GROUP BY 1, 2")(lambda s, d: versions.properties_at(_log(s, d)))
plan("log_nodes_at", f"WITH {LOG}, x AS (SELECT min(tx) + 200 AS x FROM l), {NODES.format('AND tx <= (SELECT x FROM x)')} SELECT id, 'User' AS label FROM n")(lambda s, d: versions.nodes_at(_log(s, d), _log(s, d).agg(F.min("tx_id") + 200).first()[0]))
plan("delta_slice", f"WITH {LOG}, x AS (SELECT min(tx) AS x FROM l) SELECT tx AS tx_id, count(*) AS n FROM c, x WHERE tx > x + 100 AND tx <= x + 200 GROUP BY 1")(lambda s, d: versions.delta(_log(s, d), _log(s, d).agg(F.min("tx_id") + 100).first()[0], _log(s, d).agg(F.min("tx_id") + 200).first()[0]).groupBy("tx_id").agg(F.count("*").alias("n")))


# analytics
def _link_graph(spark: SparkSession, d: str) -> Graph:
    """Customers with all their links: one ring."""
    return _only(from_tables(spark, d), "LINK")


plan("components", f"SELECT o_orderkey + {O} AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) + {O} AS component FROM orders")(lambda s, d: community.components(_only(from_tables(s, d), "NEXT").all_nodes().select("id"), _only(from_tables(s, d), "NEXT").all_edges()))
plan("components_ring", "SELECT c_custkey AS id, 0::BIGINT AS component FROM customer")(lambda s, d: community.components(_link_graph(s, d).all_nodes().select("id"), _link_graph(s, d).all_edges()))
plan("communities")(lambda s, d: community.communities(_link_graph(s, d)))
@plan("community_sizes", "SELECT count(*) AS nodes, true AS several, true AS connected, true AS named, true AS better FROM customer")
def _community_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What holds for any communities that are worth the name: they part the nodes, are several, each is connected and
    named after its smallest node, and their modularity is above 0.3."""
    g = _link_graph(spark, d)
    found = community.communities(g)
    a, b = found.select(F.col("id").alias("src"), F.col("community").alias("cs")), found.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    inside = g.all_edges().join(a, "src").join(b, "dst").filter("cs = cd").select("src", "dst")
    same = community.components(found.select("id"), inside).join(found, "id").agg(F.min(F.col("component") == F.col("community")).alias("connected"))
    named = found.groupBy("community").agg(F.min("id").alias("least"), F.count("*").alias("members")).agg(F.sum("members").alias("nodes"), (F.count("*") > 1).alias("several"), F.min(F.col("least") == F.col("community")).alias("named"))
    return named.crossJoin(same).crossJoin(community.modularity(g, found).select((F.col("modularity") > 0.3).alias("better")))
plan("community_report")(lambda s, d: community.largest(_link_graph(s, d)))
plan("modularity")(lambda s, d: community.modularity(_link_graph(s, d), community.communities(_link_graph(s, d))))
plan("cluster_fn", "SELECT count(*) AS n, true AS many, 0::BIGINT AS least FROM customer")(lambda s, d: Session(_link_graph(s, d)).run("MATCH (c:Customer) WHERE CLUSTER(c) <= c.c_custkey RETURN count(*) AS n, count(DISTINCT CLUSTER(c)) > 1 AS many, min(CLUSTER(c)) AS least"))
plan("edge_cut", f"WITH {LINK} SELECT count(*) AS edges, count(*) FILTER (src % 4 <> dst % 4) AS cut, round(100.0 * count(*) FILTER (src % 4 <> dst % 4) / count(*), 4) AS percent FROM link")(lambda s, d: partition.edge_cut(_link_graph(s, d).all_edges(), _link_graph(s, d).all_nodes().select("id", F.pmod("id", F.lit(4)).alias("shard"))))
plan("edge_cut_community")(lambda s, d: partition.edge_cut(_link_graph(s, d).all_edges(), partition.by_community(community.communities(_link_graph(s, d)), 4)))
DEGREES = "WITH v AS (" + " UNION ALL ".join(f"SELECT {what} AS n FROM {table}" for _, what, table in LABELS) + "), d AS (SELECT count(*) AS d FROM (" + " UNION ALL ".join(f"SELECT '{label}' AS l, {key} AS k FROM {table}" for _, label, key, table in EDGES) + ") GROUP BY l, k) "
plan("graph_stats", DEGREES + " UNION ALL ".join([*(f"SELECT 'label' AS kind, '{label}' AS name, {what}::DOUBLE AS value FROM {table}" for label, what, table in LABELS), *(f"SELECT 'type', '{kind}', count(*)::DOUBLE FROM {table}" for kind, _, _, table in EDGES)]) + " UNION ALL SELECT 'graph', 'nodes', sum(n) FROM v UNION ALL SELECT 'graph', 'edges', sum(d) FROM d UNION ALL SELECT 'graph', 'max_degree', max(d) FROM d UNION ALL SELECT 'graph', 'min_degree', 0 UNION ALL SELECT 'graph', 'avg_degree', round((SELECT sum(d) FROM d) / (SELECT sum(n) FROM v), 6)")(lambda s, d: from_tables(s, d).statistics())
plan("degree_centrality", f"WITH {LINK} SELECT c_name AS name, count(*) AS d FROM customer JOIN (SELECT src AS k FROM link UNION ALL SELECT dst FROM link WHERE src <> dst) ON k = c_custkey GROUP BY 1 ORDER BY d DESC, name LIMIT 10")(lambda s, d: session(s, d).run("MATCH (n:Customer)-[r:LINK]-() RETURN n.c_name AS name, count(r) AS d ORDER BY d DESC, name LIMIT 10"))
HASHED = "('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 4"
plan("shard_hash", f"SELECT c_custkey AS id, {HASHED} AS shard FROM customer")(lambda s, d: _link_graph(s, d).all_nodes().select("id", partition.by_hash(F.col("id"), 4).alias("shard")))
plan("shard_range", "SELECT c_custkey AS id, CASE WHEN c_custkey < 100 THEN 0 WHEN c_custkey < 500 THEN 1 ELSE 2 END AS shard FROM customer")(lambda s, d: _link_graph(s, d).all_nodes().select("id", partition.by_range(F.col("id"), [100, 500]).cast("int").alias("shard")))
text("shard_hint", "MATCH (c:Customer) RETURN c.c_custkey AS k USING SHARD [1, 3]", f"SELECT c_custkey AS k FROM customer WHERE {HASHED} IN (1, 3)")
text("shard_one", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS k, count(*) AS n USING SHARD 2", f"SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE {HASHED} = 2 AND ('0x' || substr(md5((o_orderkey + {O})::VARCHAR), 1, 8))::BIGINT % 4 = 2 GROUP BY 1")


# files and inspection
@plan("csv_roundtrip", "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey AS region FROM nation")
def _csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    nation = spark.read.parquet(f"{d}/nation.parquet")
    nation.select(F.col("n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).coalesce(1).write.option("header", True).csv(f"{path}/nodes")
    nation.select(F.col("n_nationkey").alias("source"), F.col("n_nationkey").alias("target"), F.lit("SELF").alias("type")).coalesce(1).write.option("header", True).csv(f"{path}/edges")
    g = files.graph_csv(spark, f"{path}/nodes", f"{path}/edges")
    return Session(g).run("MATCH (n:Nation)-[:SELF]->(n) RETURN id(n) AS id, n.name AS name, n.region AS region")


plan("parquet_nodes", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size = 3")(lambda s, d: Session(Graph(s, {"Part": files.nodes_parquet(s, f"{d}/part.parquet", "p_partkey")})).run("MATCH (p:Part {p_size: 3}) RETURN id(p) AS id, p.p_name AS name"))


@plan("snapshot_roundtrip", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "snapshot")
    files.save(from_tables(spark, d), path, 1)
    return Session(files.load(spark, path, 1)).run("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(*) AS n")


@plan("etl_json", "SELECT n_name AS source, r_name AS target FROM nation JOIN region ON r_regionkey = n_regionkey")
def _etl(spark: SparkSession, d: str) -> DataFrame:
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    entity = lambda c, t: F.struct(F.col(c).alias("name"), F.lit(t).alias("type"))
    relation = lambda a, b: F.struct(a.alias("source"), b.alias("target"), F.lit("IN").alias("type"))
    doc = both.select(F.to_json(F.struct(F.array(entity("n_name", "Nation"), entity("r_name", "Region")).alias("entities"), F.array(relation(F.col("n_name"), F.col("r_name")), relation(F.col("n_name"), F.lit("NOWHERE"))).alias("relations"))).alias("json"))
    nodes, edges = files.entities_and_relations(doc)
    a, b = nodes.select(F.col("id").alias("src"), F.col("name").alias("source")), nodes.select(F.col("id").alias("dst"), F.col("name").alias("target"))
    return edges.join(a, "src").join(b, "dst").select("source", "target")


plan("reindex", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM (SELECT o_orderkey + 1000000000000 AS id FROM orders UNION ALL SELECT c_custkey FROM customer)")(lambda s, d: _only(from_tables(s, d), "PLACED").reindexed())
plan("schema", "SELECT 'node' AS element, 'Region' AS name, unnest(['r_regionkey', 'r_name']) AS property, unnest(['int', 'string']) AS type UNION ALL SELECT 'node', 'Nation', unnest(['n_nationkey', 'n_name', 'n_regionkey']), unnest(['int', 'string', 'int'])")(lambda s, d: _only(from_tables(s, d), "IN_REGION").schema())
text("explain", "EXPLAIN MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 1000 RETURN count(*) AS n", None)
plan("profile", "SELECT count(DISTINCT o_custkey) AS rows, true AS timed FROM orders")(lambda s, d: session(s, d).run("PROFILE MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS k, count(*) AS n").select("rows", (F.col("execution_time") > 0).alias("timed")))
plan("explain_pushdown", "SELECT true AS one_scan, true AS pushed, true AS pruned")(lambda s, d: session(s, d).run("EXPLAIN MATCH (p:Part) WHERE p.p_size > 10 RETURN p.p_brand AS b, count(*) AS n").agg(
    (F.count(F.when(F.col("plan").rlike(r"^\(\d+\) Scan parquet"), 1)) == 1).alias("one_scan"), (F.count(F.when(F.col("plan").rlike(r"PushedFilters:.*GreaterThan\(p_size,10\)"), 1)) == 1).alias("pushed"), (F.count(F.when(F.col("plan") == "ReadSchema: struct<p_brand:string,p_size:int>", 1)) == 1).alias("pruned")))


