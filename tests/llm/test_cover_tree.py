import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import cover_tree as c

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(2, 6), st.sampled_from([0.0, 0.01, 0.1, 0.6]))
def test_dual_traversal_misses_nothing(seed, clusters, dim, noise):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(clusters, dim)), rng.integers(1, 25, clusters), axis=0)
    x = c._unit(x + noise * rng.normal(size=x.shape) + 1e-9)
    y = x[rng.permutation(len(x))][: max(1, len(x) // 2)]
    for other, same in ((x, True), (y, False)):
        parts = c.dual_traversal(x.astype("f4"), other.astype("f4"), c.build_levels(x.astype("f4")), c.build_levels(other.astype("f4")), np.sqrt(0.1), same, most=64)
        found = [(i, j) for a, b, _ in parts for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len(set(found)), "no pair comes twice"
        found = set(found)
        assert {(a, b) for a, b in np.argwhere(x @ other.T >= 0.95).tolist() if not same or a < b} <= found


def test_levels_are_nested_and_covered():
    rng = np.random.default_rng(4)
    x = c._unit(np.repeat(rng.normal(size=(20, 3)), 30, axis=0) + 0.05 * rng.normal(size=(600, 3))).astype("f4")
    levels = c.build_levels(x)
    assert len(levels[0]["centre"]) == 1 and len(levels[-1]["centre"]) == len(x) and len(levels) > 3
    for above, level in zip(levels, levels[1:], strict=False):
        d = np.linalg.norm(x - x[level["centre"][level["node"]]], axis=1)
        assert (d <= level["radius"][level["node"]] + 1e-6).all()
        assert (above["node"] == level["parent"][level["node"]]).all(), "a node's members are its parent's"


def brute(rows, least):
    out = set()
    for k, (a, u) in enumerate(rows):
        for b, v in rows[k + 1 :]:
            if len(u) == len(v) and a != b:
                cos = np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)
                if cos >= least:
                    out.add((min(a, b), max(a, b)))
    return out


def test_pairs_are_exact(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[rng.integers(0, 30, 60)] + 0.2 * rng.normal(size=(60, 16)), base[:5] * 3])
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)
    for cell in (24, 4096):
        got = {(r.vec_id_a, r.vec_id_b) for r in c.near_pairs(df, cell=cell).collect()}
        wanted = brute([(k, np.float64(np.float32(v))) for k, v in rows], c.MIN_COSINE)
        assert got == wanted
        assert classes_of(c.near_classes(df, cell=cell)) == brute_classes(range(len(rows)), wanted)


def classes_of(df):
    return {r.vec_id: (r.class_id, r.links) for r in df.collect()}


def brute_classes(ids, pairs):
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (min(seen), len(near[i]))
    return out


def test_a_deep_tree_gives_the_same(spark):
    """Cells so small that the top of the tree is split level by level, with dense and lonely vectors."""
    rng = np.random.default_rng(5)
    dense = rng.normal(size=8) + 0.02 * rng.normal(size=(150, 8))
    x = np.concatenate([dense, rng.normal(size=(120, 8)), np.repeat(rng.normal(size=(3, 8)), 20, axis=0)])
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)
    wanted = brute([(k, np.float64(np.float32(v))) for k, v in rows], c.MIN_COSINE)
    assert classes_of(c.near_classes(df, cell=40)) == brute_classes(range(len(rows)), wanted)


def test_many_equal_vectors_are_one_node(spark):
    df = spark.range(5000).selectExpr("id AS vec_id", "array(CAST(1 AS float), CAST(2 AS float)) AS embedding")
    got = c.near_classes(df).collect()
    assert len(got) == 5000 and {(r.class_id, r.links) for r in got} == {(0, 4999)}


def test_text_ids(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert classes_of(c.near_classes(df)) == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0)}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], None), (2, [2.0, 0.0], None), (3, [1e-30, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [0.0, 1.0], 0), (12, [1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS cell", "4 AS pivot", "5 AS x")
    got = sorted((r.vec_id_a, r.vec_id_b, r.cosine) for r in c.near_pairs(df).collect())
    assert got == [(1, 2, 1.0), (1, 3, 1.0), (1, 12, 1.0), (2, 3, 1.0), (2, 12, 1.0), (3, 12, 1.0), (10, 11, 1.0)]
    assert c.near_pairs(df.limit(0)).count() == 0
    items = sorted(((r.vec_id, r.class_id, r.links) for r in c.near_classes(df).collect()), key=str)
    assert items == sorted([(1, 1, 3), (2, 1, 3), (3, 1, 3), (12, 1, 3), (12, 12, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (None, None, 0), (10, 10, 1), (11, 10, 1)], key=str)
    assert c.near_classes(df.limit(0)).count() == 0


def shuffled(spark, since=-1):
    """(bytes, last stage): what the stages after ``since`` have written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    each = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(k) for k in range(stages.size()))]
    return sum(b for k, b in each if k > since), max((k for k, _ in each), default=-1)


def test_cells_are_not_copied_to_be_compared(spark):
    """Vectors without structure, so that each cell meets each other one."""
    x = np.random.default_rng(6).normal(size=(1200, 64)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    _, last = shuffled(spark)
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert {links for _, links in classes_of(c.near_classes(df, cell=40)).values()} == {0}
    assert shuffled(spark, last)[0] < 10 * x.nbytes
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


def test_each_pair_of_cells_meets_once():
    for n, size, strips in [(1, 1, 1), (2, 1, 1), (7, 1, 2), (8, 2, 1), (9, 2, 3), (23, 4, 2), (24, 4, 2), (5, 8, 1)]:
        heads = [{"dim": 1 + (k >= n - 2), "centre": np.zeros(1 + (k >= n - 2)).tobytes(), "radius": 0.0} for k in range(n)]
        tasks = [c._meetings(t, heads, size, strips, 1.0) for t in range(-(-n // size) * strips)]
        got = [tuple(sorted((i, j))) for met in tasks for j, near in met.items() for i in near]
        assert sorted(got) == [(i, j) for i in range(n) for j in range(i, n) if heads[i]["dim"] == heads[j]["dim"]]
