"""Communities and components of the whole LINK graph, a single ring, against brute force."""

from collections import Counter, defaultdict

from graphloom.operators import community
from graphloom.plans import workload


def links(spark, data):
    return [(r.src, r.dst) for r in workload._link_graph(spark, data).all_edges().select("src", "dst").collect()]


def reached(start, near):
    seen, todo = {start}, [start]
    while todo:
        for y in near[todo.pop()] - seen:
            seen.add(y)
            todo.append(y)
    return seen


def score(edges, at):
    both = [(a, b) for a, b in edges if a != b] + [(b, a) for a, b in edges if a != b]
    degree = Counter(at[a] for a, _ in both)
    return sum(at[a] == at[b] for a, b in both) / len(both) - sum((k / len(both)) ** 2 for k in degree.values())


def test_components_of_the_whole_ring(spark, data):
    near = defaultdict(set)
    for a, b in links(spark, data):
        near[a].add(b)
        near[b].add(a)
    g = workload._link_graph(spark, data)
    got = {r.id: r.component for r in community.components(g.all_nodes().select("id"), g.all_edges()).collect()}
    assert got == {x: min(reached(x, near)) for x in got}


def test_communities_use_every_link(spark, data):
    edges = links(spark, data)
    at = {r.id: r.community for r in workload.QUERIES["communities"](spark, data).collect()}
    assert len(at) == len({x for e in edges for x in e})
    assert any(a // 10 != b // 10 for a, b in at.items()), "no link between tens was used"
    near = defaultdict(set)
    for a, b in edges:
        if at[a] == at[b]:
            near[a].add(b)
            near[b].add(a)
    assert all(at[x] == min(reached(x, near)) for x in at), "a community falls apart"
    assert abs(workload.QUERIES["modularity"](spark, data).first()[0] - score(edges, at)) < 1e-9
    assert {r.community: r.members for r in workload.QUERIES["community_report"](spark, data).collect()}.items() <= Counter(at.values()).items()
    cut = workload.QUERIES["edge_cut_community"](spark, data).first()
    assert cut.edges == len(edges)


def test_moves_go_on_until_no_node_gains(spark, data):
    # a long path needs far more rounds than a small part of the ring
    pairs = [(k, k + 1) for k in range(400)] + links(spark, data)
    pairs = [(a, b) for a, b in pairs if a != b]
    both = Counter(pairs + [(b, a) for a, b in pairs])
    df = spark.createDataFrame([(a, b, float(w)) for (a, b), w in both.items()], "src bigint, dst bigint, w double")
    at = {r.id: r.community for r in community.modularity_moves(df).collect()}
    total, degree, heavy, near = sum(both.values()), Counter(), Counter(), defaultdict(Counter)
    for (a, b), w in both.items():
        degree[a] += w
        heavy[at[a]] += w
        near[a][at[b]] += w
    for x, own in at.items():
        gain = lambda c, x=x, own=own: near[x][c] - degree[x] * (heavy[c] - (degree[x] if c == own else 0)) / total
        assert all(gain(c) <= gain(own) + 1e-8 for c in near[x])


def test_no_round_goes_through_the_driver(spark):
    # rounds are many, so that what each broadcasts adds up, however little it is
    at = spark.createDataFrame([(k, k % 3, 2.0) for k in range(9)], "id bigint, community bigint, k double")
    edges = spark.createDataFrame([(k, (k + j) % 9, 1.0) for k in range(9) for j in (1, -1)], "src bigint, dst bigint, w double")
    plans = []
    keep, community.materialise = community.materialise, lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label)
    try:
        community._looked(edges, at, 18.0)
    finally:
        community.materialise = keep
    assert plans and not any("BroadcastExchange" in p for p in plans)
