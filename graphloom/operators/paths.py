"""Paths: variable length and shortest, as chains of joins between a frontier and the edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialise, shuffled

#: Up to so many hops the whole chain is one plan; beyond, each hop is written and an empty frontier ends it.
UNROLLED = 4
#: Up to so many paths at the frontier several hops are written at once.
FEW = 10_000
#: A search between two nodes goes on from both ends in the driver while its frontiers stay below this.
NARROW = 20_000


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("eid").alias("_eid"))


def variable_length(starts: DataFrame, edges: DataFrame, low: int, high: int | None) -> DataFrame:
    """(start, end, path, eids) of all paths of low..high edges that visit no node twice.

    ``starts`` has the distinct ids to start from, ``edges`` from, to and eid. Parallel edges give a path each.
    Without an upper bound paths grow until none can be extended.
    """
    steps, long = _steps(edges), high is None or high > UNROLLED
    if long:
        # many hops: the edges are worked out once, and nothing is broadcast, as that would go through the driver at each
        steps = shuffled(materialise(steps, "steps"))
    front = starts.select(F.col("start"), F.col("start").alias("end"), F.array("start").alias("path"), F.array().cast("array<bigint>").alias("eids"))
    found, hop, few = [], 0, False
    while high is None or hop < high:
        # a table holds one hop, or several where the frontier is small and a write costs more than the joins
        todo = UNROLLED if few else 1
        todo = todo if high is None else min(todo, high - hop)
        levels = []
        for _ in range(todo):
            joined = front.join(steps, F.col("end") == F.col("_from")).filter(~F.array_contains("path", F.col("_to")))
            front = joined.select("start", F.col("_to").alias("end"), F.concat("path", F.array("_to")).alias("path"), F.concat("eids", F.array("_eid")).alias("eids"))
            hop += 1
            levels.append(front.withColumn("_hop", F.lit(hop)))
        if long:
            table = materialise(reduce(DataFrame.unionByName, levels), "paths")
            front = table.filter(F.col("_hop") == hop).drop("_hop")
            found.append(table.filter(F.col("_hop") >= low).drop("_hop"))
            size = front.limit(FEW + 1).count()
            if not size:
                break
            few = size <= FEW
        elif hop >= low:
            found.append(front)
    return reduce(DataFrame.unionByName, found) if found else front.filter(F.lit(False))


def shortest(starts: DataFrame, edges: DataFrame, high: int | None, targets: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(start, end, path) with one shortest path of 1..high edges from each start to each node it reaches, or,
    with ``every``, all of them.

    Of equally short paths the lexicographically smallest is taken. ``targets`` (end) limits the ends, and the
    search stops once every start has reached every one of them; without ``high`` it goes on until nothing new is
    reached. Each level is one join of the frontier with the edges, which are worked out once and never broadcast where
    levels may be more than ``UNROLLED``, and one anti-join with what was reached before; levels are written, so lineage stays short. A search from one node
    for another runs from both ends while the frontiers stay narrow.
    """
    long = high is None or high > UNROLLED
    if long:
        edges = materialise(edges.select("from", "to"), "steps")
    if targets is not None and not every:
        one, other = starts.limit(2).collect(), targets.limit(2).collect()
        if len(one) == len(other) == 1 and one[0][0] != other[0][0]:
            known, path = _between(edges, one[0][0], other[0][0], high)
            if known:
                rows = [] if path is None else [(path[0], path[-1], path)]
                return edges.sparkSession.createDataFrame(rows, "start bigint, end bigint, path array<bigint>")
    apart = shuffled if long else lambda df: df
    steps = apart(edges.select(F.col("from").alias("_from"), F.col("to").alias("_to")))
    front = starts.select("start", F.col("start").alias("end"), F.array("start").alias("path"))
    seen = front.select("start", "end")
    wanted = starts.count() * targets.count() if targets is not None else None
    aims = None if targets is None else targets.withColumn("_aim", F.lit(True))
    levels, reached, hop = [], 0, 0
    while high is None or hop < high:
        hop += 1
        new = front.join(steps, F.col("end") == F.col("_from")).select("start", F.col("_to").alias("end"), F.concat("path", F.array("_to")).alias("path"))
        new = new.distinct() if every else new.groupBy("start", "end").agg(F.min("path").alias("path"))
        front = materialise(apart(new).join(seen, ["start", "end"], "left_anti"), "frontier")
        ends = front.select("start", "end").distinct() if every else front.select("start", "end")
        if targets is None:
            size, hits = (0 if front.isEmpty() else 1), 0
        else:
            size, hits = ends.join(aims, "end", "left").agg(F.count("*"), F.count("_aim")).first()
        if not size:
            break
        levels.append(front)
        seen = seen.unionByName(ends)
        if hop % 8 == 0:
            seen = materialise(seen, "seen")
        reached += hits
        if wanted is not None and reached >= wanted:
            break
    found = reduce(DataFrame.unionByName, levels) if levels else front.filter(F.lit(False))
    return found if targets is None else found.join(targets, "end", "left_semi")


def _between(edges: DataFrame, s: int, t: int, high: int | None) -> tuple[bool, list[int] | None]:
    """(known, path): the smallest shortest path from s to t, None if there is none. Not known if a frontier would
    grow beyond ``NARROW``: no more rows than that ever come to the driver at once.

    Each scan of the edges fetches those that leave the near frontier and those that enter the far one.
    """
    layers = {"from": {s}, "to": {t}}
    seen = {"from": {s}, "to": {t}}
    ways: dict[str, list[dict[int, set[int]]]] = {"from": [], "to": []}
    hops = 0
    while high is None or hops < high:
        touched = " OR ".join(f"`{side}` IN ({','.join(map(str, sorted(layers[side])))})" for side in layers)
        rows = edges.filter(F.expr(touched)).select("from", "to").limit(NARROW * 4 + 1).collect()
        if len(rows) > NARROW * 4:
            return False, None
        for side, far in (("from", "to"), ("to", "from")):
            if high is not None and hops >= high:
                break
            step: dict[int, set[int]] = {}
            for r in rows:
                if r[side] in layers[side] and r[far] not in seen[side]:
                    step.setdefault(r[side], set()).add(r[far])
            fresh = set().union(*step.values()) if step else set()
            hops += 1
            if not fresh:
                return True, None
            if len(fresh) > NARROW:
                return False, None
            ways[side].append(step)
            layers[side] = fresh
            seen[side] |= fresh
            meet = fresh & layers[far]
            if meet:
                return True, _smallest(s, meet, ways)
    return True, None


def _smallest(s: int, meet: set[int], ways: dict[str, list[dict[int, set[int]]]]) -> list[int]:
    """The lexicographically smallest of the paths that lead from s, layer by layer, over a node of ``meet``."""
    onward: list[dict[int, set[int]]] = []
    useful = meet
    for step in reversed(ways["from"]):
        kept = {a: b & useful for a, b in step.items() if b & useful}
        onward.insert(0, kept)
        useful = set(kept)
    for step in reversed(ways["to"]):
        turned: dict[int, set[int]] = {}
        for b, nearer in step.items():
            for a in nearer:
                turned.setdefault(a, set()).add(b)
        onward.append(turned)
    path = [s]
    for step in onward:
        path.append(min(step[path[-1]]))
    return path
