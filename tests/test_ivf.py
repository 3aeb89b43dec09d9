"""Search over cells against the exact neighbours of every row."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import vector
from graphloom.plans import workload


def test_ivf_search_finds_the_neighbours_of_every_row(spark, data):
    found = workload.QUERIES["ivf_search"](spark, data).collect()
    rows = workload._vectors(spark, data).collect()
    v = np.array([r.v for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    ids = [r.id for r in rows]
    wanted = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:10] if ids[i] % 50 == 0}
    got = {(r.query, r.id) for r in found}
    assert len(found) == 10 * sum(i % 50 == 0 for i in ids) == len(wanted)
    assert len(got & wanted) >= 0.999 * len(wanted), "only ties may differ"


def test_cells_are_left_out_only_if_they_hold_no_neighbour(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8)) * 5
    rows = [(k, [float(x) for x in centres[k % 4] + rng.normal(size=8)]) for k in range(120)] + [(500, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    model, filed = vector.ivf(df, 6)
    key = lambda d: {(r.query, r.id, None if r.similarity is None else round(r.similarity, 9)) for r in d.collect()}
    assert key(vector.ivf_join(model, filed, 5)) == key(vector.knn_join(df, df, 5))


def test_equal_vectors_go_by_their_ids_and_no_pair_is_a_row(spark, monkeypatch):
    # units of few vectors, so that copies of a vector stand in several
    monkeypatch.setattr(vector, "UNIT", 64)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(10, 16)).astype(np.float32)
    rows = [(k, [float(x) for x in base[k * 7 % 10]]) for k in range(600)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    model, filed = vector.ivf(df, 3)
    found = vector.ivf_join(model, filed, 5, F.expr("id % 50 = 0"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    got = {(r.query, r.id) for r in found.collect()}
    assert got == {(q, i) for q in range(0, 600, 50) for i in [k for k in range(600) if k * 7 % 10 == q * 7 % 10 and k != q][:5]}
