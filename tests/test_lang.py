import pytest

from graphloom.graph import EdgeFrame, Graph, NodeFrame, demo_graph
from graphloom.lang import ast
from graphloom.lang.lexer import QueryError
from graphloom.lang.parser import parse
from graphloom.session import Session


@pytest.fixture(scope="module")
def demo(spark):
    return Session(demo_graph(spark))


def got(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n) RETURN n extra",
        "MATCH (n RETURN n",
        "MATCH (n) RETURN",
        "MATCH (n) WHERE RETURN n",
        "RETURN 1 LIMIT",
        "MATCH (a)-[:T*1..]->(b)-> RETURN a",
        "MATCH (n) RETURN n; MATCH (m) RETURN m",
        "RETURN 'open",
        "RETURN ~1",
        "CALL graph.search(",
        "MATCH p = shortestPath((a)-[]->(b)-[]->(c)) RETURN p",
        "",
    ],
)
def test_what_is_not_read_to_its_end_is_an_error(text):
    with pytest.raises(QueryError):
        parse(text)


def test_shapes():
    q = parse("MATCH (a:P {x: 1})-[r:T:2]->(b)<-[:U*2..4]-(c) WHERE a.x = 1 AND NOT b.y IS NULL RETURN a.x AS x ORDER BY x DESC SKIP 1 LIMIT 2")
    m, r = q.clauses
    assert (m.patterns[0].rels[0].port, m.patterns[0].rels[1].hops, m.patterns[0].rels[1].direction) == (2, (2, 4), "in")
    assert r.skip == ("lit", 1) and r.order == [(("var", "x"), True)]
    assert parse("MATCH (a)-[*]->(b) RETURN a").clauses[0].patterns[0].rels[0].hops == (1, None)
    assert parse("MATCH (a)-[*3]->(b) RETURN a").clauses[0].patterns[0].rels[0].hops == (3, 3)
    assert parse("MATCH (a)-[*..3]->(b) RETURN a").clauses[0].patterns[0].rels[0].hops == (1, 3)
    assert parse("MATCH (n) RETURN n USING SHARD [1, 2]").shards == [1, 2]
    assert isinstance(parse("BEGIN"), ast.Command)
    call = parse("CALL a.b.c('x', [1, 2]) YIELD node AS n, score")
    assert (call.name, call.yields) == ("a.b.c", [("node", "n"), ("score", "score")])


def test_demo_graph(demo):
    assert got(demo.run("MATCH (n) RETURN count(*) AS n")) == [(4,)]
    assert sorted(got(demo.run("MATCH (n:Person) WHERE n.age > 28 RETURN n.name AS name"))) == [("Alice",), ("Charlie",)]
    assert got(demo.run("MATCH (n:Person) RETURN sum(n.age) AS s, avg(n.age) AS a, min(n.age) AS lo, max(n.age) AS hi")) == [(90.0, 30.0, 25, 35)]
    assert sorted(got(demo.run("MATCH (n) WHERE n.age < 30 RETURN n.name AS name"))) == [("Acme",), ("Bob",)], "NULL is below every number"
    assert got(demo.run("MATCH (p:Person)-->(c:Company) RETURN collect(p.name) AS names")) == [(["Alice", "Bob"],)]


def test_values(demo):
    one = lambda e: got(demo.run(f"RETURN {e} AS x"))[0][0]
    assert one("42 = 42.0") is True and one("NULL = NULL") is True and one("NULL < 5") is True and one("4 < 5.0") is True
    assert one("'a' = 1") is False and one("'a' <= 1") is True and one("'a' < 1") is False and one("'a' <> 1") is True
    assert one("NOT 1 = 2") is True and one("NOT 0") is True and one("'' OR [1]") is True
    assert one("coalesce(NULL, 'Fallback')") == "Fallback" and one('toLower("HELLO")') == "hello" and one('split("a,b", ",")') == ["a", "b"]
    assert one("split('a.b', '.')") == ["a", "b"] and one("split('ab', '')") == ["", "a", "b", ""]
    assert one("CASE 30 WHEN 30 THEN 'Thirty' ELSE 'Other' END") == "Thirty" and one("CASE WHEN NULL THEN 1 END") is None
    assert one("toString('a')") == "a" and one("toInteger('7x')") is None and one("toInteger(3.9)") == 3 and one("toBoolean(1)") is None
    assert one("3 IN [1, NULL, 3]") is True and one("NULL IN [NULL]") is True and one("2 IN []") is False
    assert one("7 / 2") == 3 and one("7 / 2.0") == 3.5 and one("1 / 0") is None and one("-7 % 3") == -1 and one("'a' + 1") == "a1"
    assert one("[1, 2, 3][5]") is None and one("last([1, 2])") == 2 and one("size('abc')") == 3 and one("{a: {b: 4}}.a.b") == 4
    assert one("soundex('Robert')") == "R163" and one("'it\\'s'") == "it's"


def test_rows(demo):
    assert got(demo.run("UNWIND $l AS x RETURN x AS x", l=[1, 2, 3])) == [(1,), (2,), (3,)]
    assert got(demo.run("UNWIND NULL AS x RETURN x AS x")) == [] and got(demo.run("UNWIND [] AS x RETURN x AS x")) == [] and got(demo.run("UNWIND 5 AS x RETURN x AS x")) == [(5,)]
    assert demo.run("MATCH (n:Person) RETURN n.name").columns == ["n.name"]
    assert demo.run("MATCH (n:Person) RETURN count(*)").columns == ["count(*)"]
    assert got(demo.run("MATCH (n:Person) RETURN n.name AS name ORDER BY n.age DESC LIMIT 1")) == [("Charlie",)]
    assert got(demo.run("MATCH (n) RETURN n.age AS age ORDER BY age SKIP 1 LIMIT 2")) == [(25,), (30,)]
    assert got(demo.run("MATCH (n:Person) WHERE n.age > 99 RETURN count(*) AS n, sum(n.age) AS s")) == [(0, None)]
    assert got(demo.run("MATCH (count:Person) WHERE id(count) = 1 RETURN count.name AS order")) == [("Bob",)]
    assert got(demo.run("MATCH (a:Person) OPTIONAL MATCH (a)-[:NONE]->(b) RETURN count(a) AS a, count(b) AS b")) == [(3, 0)]
    assert got(demo.run("MATCH (), () RETURN count(*) AS n")) == [(16,)], "nodes without names are not one node"
    with pytest.raises(QueryError):
        demo.run("MATCH (n) RETURN m")
    with pytest.raises(QueryError):
        demo.run("MATCH (n) WHERE n.age = $missing RETURN n")
    with pytest.raises(QueryError):
        demo.run("RETURN nothing(1)")


@pytest.fixture(scope="module")
def chain(spark):
    nodes = spark.createDataFrame([(k, "n") for k in range(6)], "id bigint, name string")
    edges = spark.createDataFrame([(k, s, d, 0) for k, (s, d) in enumerate([(0, 1), (1, 2), (2, 3), (3, 4), (1, 5)])], "eid bigint, src bigint, dst bigint, port int")
    return Session(Graph(spark, {"N": NodeFrame(nodes)}, {"KNOWS": EdgeFrame(edges, "N", "N")}))


def test_variable_length(chain):
    paths = lambda hops, end: got(chain.run(f"MATCH p = (a)-[:KNOWS*{hops}]->(b) WHERE id(a) = 0 AND id(b) = {end} RETURN length(p) AS n"))
    assert paths("1..3", 2) == [(2,)] and paths("1..3", 4) == [] and paths("1..5", 4) == [(4,)] and paths("", 4) == [(4,)]
    assert got(chain.run("MATCH (a)-[:KNOWS*1..2]->(b) WHERE id(a) = 0 RETURN count(*) AS n")) == [(3,)]
    assert got(chain.run("MATCH (a)<-[r:KNOWS*2]-(b) WHERE id(a) = 2 RETURN id(b) AS b, size(r) AS n")) == [(0, 2)]
    assert sorted(got(chain.run("MATCH (a)-[:KNOWS*0..1]->(b) WHERE id(a) = 1 RETURN id(b) AS b"))) == [(1,), (2,), (5,)]


def test_shortest(chain):
    assert got(chain.run("MATCH p = shortestPath((a)-[:KNOWS*]->(b)) WHERE id(a) = 0 AND id(b) = 2 RETURN p AS p")) == [([0, 1, 2],)]
    assert got(chain.run("MATCH (a:N), (b:N) WHERE id(a) = 3 AND id(b) = 3 MATCH p = shortestPath((a)-[:KNOWS*]->(b)) RETURN length(p) AS n")) == [(0,)]
    assert len(got(chain.run("MATCH p = shortestPath((a)-[:KNOWS*]->(b)) WHERE id(a) = 0 RETURN id(b) AS b, length(p) AS n"))) == 5
    assert got(chain.run("MATCH p = shortestPath((a)-[:KNOWS*..2]->(b)) WHERE id(a) = 0 AND id(b) = 4 RETURN p AS p")) == []
    assert got(chain.run("MATCH p = shortestPath((a)<-[:KNOWS*]-(b)) WHERE id(a) = 4 AND id(b) = 0 RETURN length(p) AS n")) == [(4,)]


def test_ports(spark):
    nodes = spark.createDataFrame([(0,), (1,)], "id bigint")
    edges = spark.createDataFrame([(k, 0, 1, k) for k in range(3)], "eid bigint, src bigint, dst bigint, port int")
    g = Graph(spark, {"A": NodeFrame(nodes)}, {"TRANSFER": EdgeFrame(edges)})
    assert got(g.ports_between()) == [(0, 1, "TRANSFER", [0, 1, 2])]
    assert got(Session(g).run("MATCH (a)-[r:TRANSFER:1]->(b) RETURN id(r) AS r, port(r) AS p")) == [(1, 1)]


def test_validate(spark):
    nodes = spark.createDataFrame([(0,), (1,), (1,)], "id bigint")
    edges = spark.createDataFrame([(7, 0, 9, 0), (8, 9, 1, 0)], "eid bigint, src bigint, dst bigint, port int")
    g = Graph(spark, {"A": NodeFrame(nodes)}, {"T": EdgeFrame(edges, "A", "A")})
    assert sorted((r.problem, r.id) for r in g.validate().collect()) == [("no dst", 7), ("no src", 8), ("repeated id", 1)]


@pytest.mark.parametrize("query", [
    "MATCH (a:A)-[:X]->(m:M) MATCH (b:B)-[:Y]->(m) RETURN m.k AS k, count(*) AS n",
    "MATCH (a:A)-[:X]->(m:M), (b:B)-[:Y]->(m) RETURN m.k AS k, count(b) AS n",
    "MATCH (a:A)-[:X]->(m:M)<-[:Y]-(b:B) RETURN m.k AS k, count(*) AS n",
    "MATCH (a:A)-[:X]->(m:M) MATCH (b:B)-[:Y]->(m) WHERE NOT EXISTS { (m)<-[:Z]-(:A) } RETURN m.k AS k, count(*) AS n",
    "MATCH (a:A)-[:X]->(m:M) MATCH (b:B)-[:Y]->(m) MATCH (c:A)-[:Z]->(m) RETURN m.k AS k, count(*) AS n",
])
def test_rows_that_meet_at_one_node_are_counted_before_they_are_joined(spark, query):
    nodes = lambda n, off: NodeFrame(spark.range(n).selectExpr(f"id + {off} AS id", "id AS k"))
    edges = lambda a, n, off: EdgeFrame(spark.range(n).selectExpr("id AS eid", f"id + {off} AS src", "id % 3 + 100 AS dst", "0 AS port"), a, "M")
    g = Graph(spark, {"A": nodes(20, 0), "B": nodes(30, 1000), "M": nodes(3, 100)}, {"X": edges("A", 20, 0), "Y": edges("B", 30, 1000), "Z": edges("A", 2, 0)})
    x, z = {0: 7, 1: 7, 2: 6}, {0: 1, 1: 1}
    df = Session(g).run(query)
    wanted = {2: 60} if "NOT EXISTS" in query else {k: x[k] * 10 * z[k] for k in z} if ":Z" in query else {k: n * 10 for k, n in x.items()}
    assert dict(got(df)) == wanted
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") > 1
    assert got(Session(g).run(query.replace("m.k AS k, ", "").replace(" RETURN", " WHERE m.k > 5 RETURN") if "WHERE" not in query else "MATCH (a:A)-[:X]->(m:M) MATCH (b:B)-[:Y]->(m) WHERE m.k > 5 RETURN count(*) AS n")) == [(0,)]
