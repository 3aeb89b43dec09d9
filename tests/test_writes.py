from datetime import datetime

import pytest

from graphloom.graph import Graph
from graphloom.lang.lexer import QueryError
from graphloom.operators import community, versions
from graphloom.session import Session


@pytest.fixture
def fresh(spark):
    return Session(Graph(spark))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_create_and_match(fresh):
    fresh.run("CREATE (a:User {name: 'ann'}), (b:User {name: 'bo'}), (a)-[:PAL {since: 2020}]->(b)")
    assert got(fresh.run("MATCH (u:User) RETURN id(u) AS id, u.name AS name")) == [(0, "ann"), (1, "bo")]
    assert got(fresh.run("MATCH (a)-[r:PAL]->(b) RETURN a.name AS a, b.name AS b, r.since AS s, type(r) AS t")) == [("ann", "bo", 2020, "PAL")]
    fresh.run("MATCH (a:User), (b:User) WHERE a.name = 'bo' AND b.name = 'ann' CREATE (a)-[:PAL]->(b)")
    assert got(fresh.run("MATCH (a)-[r:PAL]->(b) RETURN id(r) AS r")) == [(0,), (1,)]


def test_lists_and_maps(fresh):
    fresh.run("CREATE (n:Doc {words: ['p', 'q'], setup: {loud: false, depth: 5, way: 'short'}, more: {marks: [1, 2], live: false}})")
    assert got(fresh.run("MATCH (n:Doc) RETURN size(n.words) AS n, n.setup.depth AS l, n.more.marks[1] AS s")) == [(2, 5, 2)]


def test_merge(fresh):
    for _ in range(2):
        fresh.run("MERGE (n:P {name: 'x'}) ON CREATE SET n.hits = 1 ON MATCH SET n.hits = n.hits + 1")
    assert got(fresh.run("MATCH (n:P) RETURN n.name AS name, n.hits AS h")) == [("x", 2)]
    fresh.run("MERGE (a:P {name: 'x'}) MERGE (b:P {name: 'y'}) MERGE (a)-[:T]->(b)")
    fresh.run("MATCH (a:P {name: 'x'}), (b:P {name: 'y'}) MERGE (a)-[:T]->(b)")
    assert got(fresh.run("MATCH (a)-[r:T]->(b) RETURN count(r) AS n")) == [(1,)]
    fresh.run("MERGE (n:P {name: NULL})")
    fresh.run("MERGE (n:P {name: NULL})")
    assert got(fresh.run("MATCH (n:P) RETURN count(*) AS n")) == [(3,)]


def test_set_and_delete(fresh):
    fresh.run("UNWIND [1, 2, 3] AS k CREATE (n:K {k: k})")
    fresh.run("MATCH (n:K) WHERE n.k > 1 SET n.k = n.k * 10, n.big = true")
    assert got(fresh.run("MATCH (n:K) RETURN n.k AS k, n.big IS NULL AS small")) == [(1, True), (20, False), (30, False)]
    fresh.run("MATCH (a:K {k: 1}), (b:K {k: 20}) CREATE (a)-[:T]->(b)")
    with pytest.raises(QueryError):
        fresh.run("MATCH (n:K {k: 1}) DELETE n")
    fresh.run("MATCH (n:K {k: 30}) DELETE n")
    fresh.run("MATCH (n:K {k: 1}) DETACH DELETE n")
    assert got(fresh.run("MATCH (n:K) OPTIONAL MATCH (m)-[r:T]->(n) RETURN n.k AS k, count(r) AS r")) == [(20, 0)]


def test_transactions(fresh):
    fresh.run("BEGIN")
    fresh.run("CREATE (a:U {k: 1}), (b:U {k: 2}), (a)-[:F]->(b)")
    assert fresh.graph.all_nodes().count() == 0
    with pytest.raises(QueryError):
        fresh.run("BEGIN")
    fresh.run("COMMIT")
    assert fresh.graph.all_nodes().count() == 2 and fresh.graph.all_edges().count() == 1
    fresh.run("BEGIN")
    fresh.run("CREATE (a:U {k: 3})")
    fresh.run("ROLLBACK")
    assert fresh.graph.all_nodes().count() == 2
    with pytest.raises(QueryError):
        fresh.run("COMMIT")


def test_versions(fresh):
    for hour, k in ((10, 1), (11, 2), (12, 3)):
        fresh.clock = lambda h=hour: datetime(2026, 1, 15, h)
        fresh.run(f"CREATE (n:V {{k: {k}}})")
    assert got(fresh.run("MATCH (n:V) RETURN count(*) AS n AT TIME '2026-01-15T11:30:00'")) == [(2,)]
    with pytest.raises(QueryError):
        fresh.run("MATCH (n:V) RETURN n AT TIME '2026-01-15T09:00:00'")
    assert got(fresh.run("FLASHBACK TO datetime('2026-01-15T10:30:00Z')")) == [(1,)]
    assert got(fresh.run("MATCH (n:V) RETURN count(*) AS n")) == [(1,)]


def test_log(spark):
    t = lambda h: datetime(2026, 1, 1, h)
    rows = [
        (1, t(1), "create_node", 1, "A", None, None, None, None), (1, t(1), "set", 1, None, "x", "1", None, None), (1, t(1), "create_node", 2, "A", None, None, None, None), (1, t(1), "create_edge", None, "T", None, None, 1, 2), (1, t(1), "commit", *[None] * 6),
        (2, t(2), "set", 1, None, "x", "2", None, None), (2, t(2), "commit", *[None] * 6), (3, t(3), "delete_node", 2, None, None, None, None, None), (3, t(3), "commit", *[None] * 6), (4, t(4), "set", 1, None, "x", "9", None, None),
    ]
    log = spark.createDataFrame(rows, versions.LOG_SCHEMA)
    assert got(versions.properties_at(log)) == [(1, "x", "2")] and got(versions.properties_at(log, 1)) == [(1, "x", "1")]
    assert got(versions.nodes_at(log)) == [(1, "A")] and versions.edges_at(log, 2).count() == 1 and versions.edges_at(log).count() == 0
    assert versions.tx_at(log, t(2)).first()[0] == 2 and versions.tx_at(log, datetime(2025, 1, 1)).first()[0] is None
    assert got(versions.properties_at(versions.vacuum(log.filter("tx_id < 4"), 2))) == [(1, "x", "2")]


def test_communities(spark):
    s = Session(Graph(spark))
    assert community.communities(s.graph).count() == 0
    s.run("UNWIND range(0, 7) AS k CREATE (n:N {k: k})")
    s.run("MATCH (a:N), (b:N) WHERE a.k < b.k AND (b.k < 4 OR a.k >= 4) CREATE (a)-[:T]->(b)")
    s.run("MATCH (a:N {k: 3}), (b:N {k: 4}) CREATE (a)-[:T]->(b)")
    found = community.communities(s.graph)
    assert sorted(r.members for r in community.sizes(found).collect()) == [4, 4]
    assert community.modularity(s.graph, found).first()[0] > 0.3
    assert len({tuple(r) for r in s.run("MATCH (n:N) RETURN CLUSTER(n) AS c").collect()}) == 2


def test_streamed_log(spark, tmp_path):
    from graphloom.streaming import log as stream

    rows = [(1, datetime(2026, 1, 1), "set", 1, None, "x", "1", None, None), (1, datetime(2026, 1, 1), "commit", *[None] * 6), (2, datetime(2026, 1, 2), "set", 1, None, "x", "2", None, None)]
    spark.createDataFrame(rows, versions.LOG_SCHEMA).write.parquet(str(tmp_path / "log"))
    stream.apply_to(stream.follow(spark, str(tmp_path / "log")), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(120)
    assert [r.value for r in spark.read.parquet(str(tmp_path / "state")).collect()] == ["1"]
