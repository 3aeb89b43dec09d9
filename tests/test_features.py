"""What the registered queries don't reach: errors, brute force where SQL has no counterpart, and small operators."""

import json
import math
import random
from datetime import date, datetime

import numpy as np
import pytest

from graphloom.functions import phonetics
from graphloom.graph import EdgeFrame, Graph, NodeFrame
from graphloom.lang.lexer import QueryError
from graphloom.operators import community, fulltext, partition, paths, vector, versions
from graphloom.plans import workload
from graphloom.session import Session
from graphloom.sources import files


def edges(spark, pairs):
    return spark.createDataFrame([(k, a, b, 0) for k, (a, b) in enumerate(pairs)], "eid bigint, src bigint, dst bigint, port int")


def graph(spark, n, pairs):
    return Session(Graph(spark, {"N": NodeFrame(spark.range(n).selectExpr("id", "id AS k"))}, {"T": EdgeFrame(edges(spark, pairs))}))


def test_a_chain_of_sixty_nodes_is_walked_to_its_end(spark):
    s = graph(spark, 60, [(k, k + 1) for k in range(59)])
    assert s.run("MATCH (a)-[:T*]->(b) WHERE id(a) = 0 RETURN count(*) AS n").first()[0] == 59
    assert s.run("MATCH p = shortestPath((a)-[:T*]->(b)) WHERE id(a) = 0 AND id(b) = 59 RETURN length(p) AS n").first()[0] == 59
    assert s.run("MATCH p = shortestPath((a)-[:T*]->(b)) WHERE id(a) = 40 RETURN max(length(p)) AS m, count(*) AS n").first() == (19, 19)


def all_shortest(pairs, s, t):
    best, out, front = None, [], [[s]]
    near = {}
    for a, b in set(pairs):
        near.setdefault(a, []).append(b)
    seen = {s}
    while front and best is None:
        front = [[*p, x] for p in front for x in near.get(p[-1], []) if x not in seen]
        seen |= {p[-1] for p in front}
        out = sorted(p for p in front if p[-1] == t)
        best = out or None
    return out


def test_shortest_paths_between_two_nodes(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(60)]
    s = graph(spark, 25, pairs)
    found = 0
    for _ in range(12):
        a, b = rng.sample(range(25), 2)
        wanted = all_shortest(pairs, a, b)
        found += bool(wanted)
        text = f"((a)-[:T*]->(b)) WHERE id(a) = {a} AND id(b) = {b} RETURN p AS p"
        assert [r.p for r in s.run(f"MATCH p = shortestPath{text}").collect()] == wanted[:1]
    assert found > 4
    assert sorted(r.p for r in s.run(f"MATCH p = allShortestPaths{text}").collect()) == wanted
    monkeypatch.setattr(paths, "NARROW", 0)
    assert [r.p for r in s.run(f"MATCH p = shortestPath{text}").collect()] == wanted[:1], "too wide for the driver"


def test_constraints(spark):
    s = Session(Graph(spark))
    s.run("CREATE (a:U {name: 'x'}), (b:U {name: 'y'})")
    s.run("CALL g.constraint.create('c', 'U', 'name')")
    assert [tuple(r) for r in s.run("CALL g.constraint.list()").collect()] == [("c", "U", "name")]
    for statement in ("CREATE (c:U {name: 'x'})", "MATCH (u:U {name: 'y'}) SET u.name = 'x'"):
        with pytest.raises(QueryError):
            s.run(statement)
    assert sorted(r.n for r in s.run("MATCH (u:U) RETURN u.name AS n").collect()) == ["x", "y"]
    with pytest.raises(QueryError):
        s.run("CALL g.constraint.create('c', 'U', 'name')")
    s.run("CALL g.constraint.drop('c')")
    s.run("CREATE (c:U {name: 'x'})")
    with pytest.raises(QueryError):
        s.run("CALL g.constraint.create('d', 'U', 'name')")
    with pytest.raises(QueryError):
        s.run("CALL g.constraint.drop('d')")


def test_vectors_of_another_dimension_are_refused(spark):
    s = Session(Graph(spark))
    s.run("CALL g.vectorInit(3)")
    s.run("CREATE (d:D {embedding: [1.0, 0.0, 0.0]})")
    for statement in ("CREATE (d:D {embedding: [1.0, 2.0]})", "MATCH (d:D) SET d.embedding = [1.0]", "CALL g.search([1.0], 'cosine', 1)", "CALL g.vectorInit(4)"):
        with pytest.raises(QueryError):
            s.run(statement)
    assert s.run("MATCH (d:D) RETURN count(*) AS n").first()[0] == 1


def test_json_and_csv_pages(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "e").mkdir()
    (tmp_path / "n/a.json").write_text("\n".join(json.dumps(x) for x in [{"id": 1, "label": "A", "name": "x", "tags": ["p"]}, {"id": 2, "name": "y"}]))
    (tmp_path / "e/a.json").write_text(json.dumps({"source": 1, "target": 2, "type": "T", "w": 2.5}))
    s = Session(files.graph_json(spark, str(tmp_path / "n"), str(tmp_path / "e")))
    assert [tuple(r) for r in s.run("MATCH (a:A)-[r:T]->(b) RETURN a.name AS a, a.tags[0] AS t, r.w AS w, b.name AS b, label(b) AS l").collect()] == [("x", "p", 2.5, "y", "")]
    pages = spark.createDataFrame([(1, "one\ftwo\f"), (2, None), (3, "")], "id bigint, text string")
    assert sorted(tuple(r) for r in files.pages_of_text(pages).collect()) == [(1, 0, "one"), (1, 1, "two"), (1, 2, ""), (3, 0, "")]


def test_statements_write_a_log_that_gives_back_the_graph(spark, tmp_path):
    log = str(tmp_path / "log")
    s = Session(Graph(spark), log=log, clock=lambda: datetime(2026, 1, 1))
    s.run("CREATE (a:P {name: 'x', age: 3}), (b:P {name: 'y'}), (a)-[:T]->(b)")
    s.run("MATCH (n:P {name: 'x'}) SET n.age = 4, n.nick = 'z'")
    s.run("CREATE (c:P {name: 'w'})")
    s.run("MATCH (n:P {name: 'y'}) DETACH DELETE n")
    s.run("MATCH (n:P {name: 'x'}) REMOVE n.nick")
    read = lambda: spark.read.schema(versions.LOG_SCHEMA).parquet(log)
    state = lambda tx: Session(versions.recover(read(), {"P": "name string, age bigint, nick string"}, tx)).run("MATCH (n:P) RETURN n.name AS a, n.age AS b, n.nick AS c").collect()
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(state(1)) == [("x", 3, None), ("y", None, None)]
    assert key(state(3)) == [("w", None, None), ("x", 4, "z"), ("y", None, None)]
    assert key(state(None)) == [("w", None, None), ("x", 4, None)]
    assert versions.recover(read(), {"P": "name string"}, 1).all_edges().count() == 1
    assert versions.recover(read(), {"P": "name string"}).all_edges().count() == 0


def test_many_statements_keep_plans_short(spark):
    s = Session(Graph(spark))
    s.run("CREATE (n:C {k: 0})")
    for _ in range(18):
        s.run("MATCH (n:C) SET n.k = n.k + 1")
    assert s.run("MATCH (n:C) RETURN n.k AS k").first()[0] == 18
    assert s.graph.nodes["C"].df._jdf.queryExecution().logical().toString().count("Join") <= 8


TEXTS = [(1, "Machine learning with spiral networks. Robert runs."), (2, "The network is spiral; learning is not. Rupert ran"), (3, "graph databases are about running queries"), (4, None), (5, "")]


def test_stored_index(spark):
    docs = spark.createDataFrame(TEXTS, "id bigint, text string")
    found = lambda index, q: sorted(r.id for r in fulltext.index_search(index, q, None).collect())
    plain = fulltext.build_index(docs)
    for q in ("spiral learning", '"spiral networks"', "spiral AND network", "+learning -robert", "-spiral +graph", "nothing", '"learning is not"', "is"):
        a = {r.id: round(r.score, 9) for r in fulltext.search(docs, q, None).collect()}
        assert {r.id: round(r.score, 9) for r in fulltext.index_search(plain, q, None).collect()} == a, q
    english = fulltext.build_index(docs, "english")
    assert found(english, "network") == [1, 2] and found(english, "run") == [1, 3] and found(english, "the") == []
    assert found(fulltext.build_index(docs, None, "soundex"), "Robert") == [1, 2] and found(plain, "Robert") == [1]
    assert found(fulltext.build_index(docs, None, "metaphone"), "kraf") == [3]
    assert found(plain.delete(spark.range(1, 2)), "spiral") == [2]
    assert [r.id for r in fulltext.index_fuzzy(plain, "sprial", 5, 1).collect()] == [1, 2]
    assert fulltext.index_fuzzy(plain, "sprial", 5, 0).count() == 0
    with pytest.raises(ValueError):
        fulltext.build_index(docs, None, "no such code")


def test_index_procedures(spark):
    s = Session(Graph(spark))
    s.run("CREATE (a:P {t: 'one cat', u: 'dog'}), (b:P {t: 'two cats'})")
    s.run("CALL g.fulltext.createIndex('i', 'P', ['t', 'u'], 'english', 'metaphone')")
    ask = lambda q: sorted(r.node for r in s.run("CALL g.fulltext.query('i', $q)", q=q).collect())
    assert ask("cats") == [0, 1] and ask("dog") == [0]
    s.run("CREATE (c:P {t: 'a third cat'})")
    assert ask("cat") == [0, 1]
    s.run("CALL g.fulltext.rebuild('i')")
    assert ask("cat") == [0, 1, 2]
    s.run("CALL g.fulltext.deleteDocument('i', 1)")
    assert ask("cat") == [0, 2]
    s.run("CALL g.fulltext.dropIndex('i')")
    with pytest.raises(QueryError):
        ask("cat")


def osa(a, b):
    d = [[max(i, j) if min(i, j) == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_with_swapped_neighbours(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for most in (1, 2):
        got = {r.t: r.d for r in df.select("t", fulltext.edits(df.t, "abcab", most).alias("d")).collect()}
        assert got == {w: (osa(w, "abcab") if osa(w, "abcab") <= most else None) for w in words}


def test_stems_and_sounds(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "formalize": "formal", "electrical": "electr", "adoption": "adopt", "probate": "probat", "controlling": "control", "as": "as", "übergrößen": "übergrößen"}
    assert {w: phonetics.stem(w) for w in pairs} == pairs
    sounds = {"thumb": "0M", "phone": "FN", "knight": "NT", "wrap": "RP", "school": "SKL", "chair": "XR", "nation": "NXN", "edge": "EJ", "box": "BKS", "xylem": "SLM", "": "", "42": ""}
    assert {w: phonetics.metaphone(w) for w in sounds} == sounds
    words = ["Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "Honeyman", "a", "hh", "whale", "o'neil", "x9y", "jackson"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s.upper() for r in df.selectExpr("w", "soundex(w) s").collect()} == {w: phonetics.soundex(w) for w in words}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "hamming"])
def test_knn_join(spark, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5)).round(3)
    x[7] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, [1.0, 2.0]), (201, None)], "id bigint, v array<double>")
    score = {
        "cosine": lambda a, b: float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) if (a @ a) and (b @ b) else 0.0,
        "dot": lambda a, b: float(a @ b),
        "euclidean": lambda a, b: -math.sqrt(((a - b) ** 2).sum()),
        "hamming": lambda a, b: -float(((a >= 0) != (b >= 0)).sum()),
    }[metric]
    got = vector.knn_join(df.filter("id % 10 = 7"), df, 4, metric).collect()
    wanted = {q: sorted(((round(-score(x[q], x[k]), 9), k) for k in range(90) if k != q))[:4] for q in range(7, 90, 10)}
    for q, best in wanted.items():
        assert sorted((round(-r.similarity, 9), r.id) for r in got if r.query == q) == best
    assert len(got) == 4 * len(wanted)
    with pytest.raises(ValueError):
        vector.knn_join(df, df, 3, "other")


def test_communities_are_shared_out_evenly(spark):
    sizes = [300, 120, 90, 80, 60, 40] + [1] * 400
    rows = [(k, c) for c, n in enumerate(sizes) for k in range(1000 * c, 1000 * c + n)]
    found = spark.createDataFrame(rows, "id bigint, community bigint")
    for fine in (1, 64):
        at = partition.by_community(found, 4, fine=fine).collect()
        assert len(at) == len(rows)
        by = {}
        for r in at:
            by.setdefault(r.id // 1000, set()).add(r.shard)
        assert all(len(x) == 1 for x in by.values()), "no community is cut"
        load = [sum(r.shard == s for r in at) for s in range(4)]
        assert max(load) - min(load) <= (40 if fine == 64 else 310), load


def test_edge_cut_of_communities(spark, data):
    g = workload._link_graph(spark, data)
    found = community.communities(g)
    at = {r.id: r.shard for r in partition.by_community(found, 4).collect()}
    cut = sum(at[r.src] != at[r.dst] for r in g.all_edges().select("src", "dst").collect())
    got = partition.edge_cut(g.all_edges(), partition.by_community(found, 4)).first()
    assert (got.cut, got.edges) == (cut, 3 * len(at)) and cut < 0.9 * got.edges
    top = community.report(g, found, 3).collect()
    count = {}
    for r in found.collect():
        count[r.community] = count.get(r.community, 0) + 1
    wanted = sorted(((-n, c) for c, n in count.items()))[:3]
    assert [(-r.members, r.community) for r in top] == wanted and all(abs(r.percent - round(100 * r.members / len(at), 2)) < 1e-9 for r in top)


def test_small_functions(spark):
    s = Session(Graph(spark))
    assert s.run("RETURN ltrim('  x ') AS l, rtrim(' x  ') AS r").first() == ("x ", " x")
    now = s.run("RETURN date() AS d, datetime() AS t").first()
    assert abs((now.d - date.today()).days) <= 1 and abs((now.t - datetime.now()).total_seconds()) < 2 * 86400
    g = graph(spark, 3, [(0, 1), (1, 2)])
    assert g.run("MATCH ()-[:T]->()-[:T]->() RETURN count(*) AS n").first()[0] == 1
    assert sorted(tuple(r) for r in g.graph.has_edge(spark.createDataFrame([(0, 1), (1, 0)], "src bigint, dst bigint")).collect()) == [(0, 1, True), (1, 0, False)]
    plan = [r.plan for r in g.run("EXPLAIN MATCH (a:N) RETURN count(*) AS n").collect()]
    assert any("HashAggregate" in x for x in plan)


def test_stemmed_search_finds_more_than_plain_words(spark, data):
    got = workload.QUERIES["fulltext_stems"](spark, data).collect()
    plain = fulltext.search(workload._texts(spark, data), "licensed benefits", None).count()
    assert got and all(a.score >= b.score for a, b in zip(got, got[1:], strict=False))
    assert plain <= fulltext.index_search(fulltext.build_index(workload._texts(spark, data), "english"), "the licensed benefits", None).count()
