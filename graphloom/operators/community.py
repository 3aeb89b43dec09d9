"""Communities, components and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.storage import Rolling, materialise, shuffled


def star_roots(edges: DataFrame) -> DataFrame:
    """(id, root) of each end of the edges (src, dst) but the roots: the smallest id that it is joined to.

    Large-star and small-star rounds until no pair changes; each is written to the shared folder, the one before
    deleted. The least neighbour is found by an aggregation with a partial step and joined back, so a hub's rows
    need not meet in one task. The number of rounds grows with the logarithm of a component's size.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    rounds, before = Rolling("stars"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"))
        large = shuffled(both).join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = shuffled(large).join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = rounds.keep(turned.select("e.u", "e.v").filter("u <> v").distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id is joined to, whatever the direction of the edges (src, dst)."""
    roots = star_roots(edges).withColumnRenamed("id", "_u")
    return shuffled(ids).join(roots, F.col("id") == F.col("_u"), "left").select("id", F.coalesce("root", "id").alias("component"))


def modularity_moves(edges: DataFrame) -> DataFrame:
    """(id, community) by local moves that raise modularity, over undirected weights (src, dst, w) given both ways.

    In each round every node looks at the communities of its neighbours for the largest gain, and half of those
    that gain, by hash, move at once. Where nodes that move together only chase each other, so that modularity
    does not rise, the round is taken back and half as many are tried; one alone always gains. So modularity
    rises with every round that stays, and the end is reached when no node gains by a move. A round is three
    joins, of which none is broadcast: there are many rounds, and each would go through the driver. The edges are
    sent twice a round, all else is a row for each node; nothing is collected but sums.
    """
    degree = materialise(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    total = float(degree.agg(F.sum("k")).first()[0])
    best, movers, score = _looked(edges, degree.select("id", F.col("id").alias("community"), "k"), total)
    tries = r = 0
    while movers:
        r, tries = r + 1, tries + 1
        alone = movers < 2**tries
        if alone:
            first = best.filter("target <> community").orderBy(F.desc("gain"), "id").first()
            turn = F.col("id") == first["id"]
        else:
            turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2**tries)) == 0
        tried = _looked(edges, best.select("id", F.when(turn, F.col("target")).otherwise(F.col("community")).alias("community"), "k"), total)
        if alone or tried[2] > score:
            best, movers, score = tried
            tries = 0
    return best.select("id", "community")


def _looked(edges: DataFrame, at: DataFrame, total: float) -> tuple[DataFrame, int, float]:
    """For nodes at (id, community, k): the same with the best community and its gain; how many would move; the modularity."""
    heavy = at.groupBy("community").agg(F.sum("k").alias("tot"))
    placed = shuffled(at).join(heavy, "community").select("id", F.col("community").alias("c"), "tot")
    # every node tells its neighbours its community and that one's weight, and itself, which marks where it is
    told = shuffled(edges.filter("src <> dst")).join(placed.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "c", "tot", "w", F.lit(False).alias("stay"))
    own = placed.select("id", "c", "tot", F.lit(0.0).alias("w"), F.lit(True).alias("stay"))
    # all that follows is by node: what was told is sent once
    tried = told.unionByName(own).repartition("id").groupBy("id", "c").agg(F.sum("w").alias("links"), F.max("tot").alias("tot"), F.max("stay").alias("stay"))
    scored = _scored(shuffled(tried).join(at.select("id", "k"), "id"), total)
    best = scored.groupBy("id").agg(
        F.max(F.when(F.col("stay"), F.col("c"))).alias("community"), F.max("k").alias("k"), F.max(F.struct("gain", "stay", (-F.col("c")).alias("least"))).alias("b"),
        F.max(F.when(F.col("stay"), F.col("links"))).alias("inside"), F.max(F.when(F.col("stay"), F.col("tot"))).alias("tot"),
    )
    best = materialise(best.select("id", "community", "k", (-F.col("b.least")).alias("target"), "b.gain", "inside", "tot"), "moves")
    movers, inside, squares = best.agg(F.count(F.when(F.col("target") != F.col("community"), 1)), F.sum("inside"), F.sum(F.col("k") * F.col("tot"))).first()
    return best, movers, inside / total - squares / total / total


def _scored(tried: DataFrame, total: float) -> DataFrame:
    """With the gain in modularity (times a constant) of a node in each community that it could be in."""
    rest = F.col("tot") - F.when(F.col("stay"), F.col("k")).otherwise(F.lit(0.0))
    return tried.withColumn("gain", F.round(F.col("links") - F.col("k") * rest / F.lit(total), 9))


def communities(graph: Graph) -> DataFrame:
    """(id, community) of the nodes that have edges; each community is connected and named after its smallest id."""
    ends = graph.all_edges().select("src", "dst").filter("src <> dst")
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    edges = materialise(both, "weights")
    if edges.isEmpty():
        return graph.spark.range(0).select("id", F.col("id").alias("community"))
    found = modularity_moves(edges)
    a = found.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    b = found.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    inside = shuffled(shuffled(edges).join(a, "src")).join(b, "dst").filter("cs = cd").select("src", "dst")
    return materialise(components(found.select("id"), inside).withColumnRenamed("component", "community"), "communities")


def sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("community").agg(F.count("*").alias("members"))


def largest(graph: Graph, k: int = 10) -> DataFrame:
    """The k largest communities with their share of all nodes in percent."""
    return report(graph, communities(graph), k)


def report(graph: Graph, found: DataFrame, k: int) -> DataFrame:
    n = graph.all_nodes().agg(F.count("*").alias("n"))
    return sizes(found).crossJoin(n).select("community", "members", F.round(100 * F.col("members") / F.col("n"), 2).alias("percent")).orderBy(F.desc("members"), "community").limit(k)


def modularity(graph: Graph, found: DataFrame) -> DataFrame:
    """One row with the modularity of communities over the undirected edges."""
    ends = graph.all_edges().select("src", "dst").filter("src <> dst")
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a = found.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    b = found.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    per = shuffled(shuffled(both).join(a, "src")).join(b, "dst").groupBy("cs").agg(F.count("*").alias("k"), F.count(F.when(F.col("cs") == F.col("cd"), 1)).alias("inside"))
    total = both.agg(F.count("*").alias("m2"))
    return per.crossJoin(total).agg(F.sum(F.col("inside") / F.col("m2") - (F.col("k") / F.col("m2")) * (F.col("k") / F.col("m2"))).alias("modularity"))
