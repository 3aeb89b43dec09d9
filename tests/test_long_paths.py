"""Searches of many hops: edges are worked out once, and no hop goes through the driver."""

from pyspark.sql import functions as F

from graphloom.operators import paths


def test_no_hop_of_a_long_search_is_broadcast(spark, monkeypatch):
    plans = []
    keep = paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    # edges that are a join themselves, as those of a table that is joined with itself
    edges = spark.range(12).join(spark.range(12).selectExpr("id AS to"), F.col("id") + 1 == F.col("to")).selectExpr("id AS from", "to", "id AS eid")
    starts = spark.createDataFrame([(0,)], "start bigint")
    got = paths.variable_length(starts, edges, 1, None).collect()
    assert {r.end: r.path for r in got} == {k: list(range(k + 1)) for k in range(1, 12)}
    one = paths.shortest(starts, edges, None, spark.createDataFrame([(11,)], "end bigint")).collect()
    assert [r.path for r in one] == [list(range(12))]
    # the edges' own join may be: it runs once for a search
    assert sum("Broadcast" in p for p in plans) <= 2 < len(plans)
