"""Operator 5: embedding near-duplicates by dual traversal of cover trees.

Vectors are scaled to length 1; a pair is a near duplicate if its cosine is at least ``min_cosine``, that is,
if its distance is at most ``reach = sqrt(2 - 2 * min_cosine)``. ``near_classes`` gives every item its class (the
connected component over near pairs, named after its smallest id) and the number of its links, without ever making
a row of a pair; ``near_pairs`` lists the pairs themselves.

1. Equal vectors are one node with a weight, found by an aggregation with a partial step.
2. The top of the tree is grown from a bounded sample (``DRAWN`` bytes of vectors in all): radii halve from 1; in every
   node that is still too large, centres farther apart than the level's radius are chosen, and each vector goes to its
   nearest centre, level by level. Every vector is routed, in one pass and without a shuffle. Centres only decide how
   much is pruned: results are exact for any.
3. The vectors at the end of a path are a cell (several, by hash, where they are too many). A cell keeps its mean and its
   covering radius (the distance of its farthest vector), and the nested levels are built on in it down to the vectors.
   It is written once, as a file of one row.
4. Dual traversal: a pair of cells is dropped if the distance of their means exceeds the sum of the covering radii plus
   the reach. Pairs that are left are traversed together inside a task, level by level, down to blocks of vectors that are
   compared as a matrix product. A task holds a few cells and reads those that it meets from the shared folder, one at a
   time: no cell is copied or shuffled for a comparison, however many it meets.
5. A task gives, for each vector with a partner, the weight of its partners and the smallest id that it is
   joined to there: at most a row a vector. Links are added up; classes are the components of these joins.
   Tables and shuffle files of a step go as soon as the next one is written.

In high dimension, vectors without structure are all about as far from each other, so that balls overlap and the
traversal compares all cells, block by block, which is quadratic in time, not in disk; equal and clustered vectors are pruned.

Defined results of ``near_classes``: a row for each distinct (vec_id, embedding), so repeated rows count once, and
an id with two vectors has two rows, linked if they are near. Vectors that are NULL, empty, of zero length, or hold
NULL, NaN or infinite values are alone in the class of their own id with 0 links; so are rows without an id (class
NULL). Vectors of different dimensions are never near; vectors of any length are compared whole. Ids of any type that
can be ordered will do. An empty table gives no rows. Only the id and the vector are read, whatever other columns are
called. ``near_pairs`` gives (smaller id, larger id) once, without pairs of an id with itself.
"""

from __future__ import annotations

import itertools
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import local_roots, table
from graphloom.operators.blocks import as_bytes, matrix
from graphloom.operators.community import star_roots
from graphloom.storage import materialise, materialise_step, swept

MIN_COSINE = 0.95
#: Vectors of a cell, about; and children of a node, at most.
CELL = 8192
FANOUT = 64
#: Bytes of vectors that the top of the tree is grown from; bytes and number of the cells that a task holds at most, and
#: how many others it meets, about; tasks at most.
DRAWN = 8 << 20
HELD, HOLD = 64 << 20, 8
STRIP = 64
TASKS = 20_000
LEAF_RADIUS = 0.125
#: What float32 rounding may add to a distance of unit vectors.
SLACK = 1e-3


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def separated(x: np.ndarray, radius: float, first: int = 0, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner): rows of x, each farther than radius from the earlier ones, that cover all of x unless there
    are ``most`` of them; and the nearest centre of every row. Candidates are tried 64 at a time."""
    centres = np.array([first])
    best = _squared(x[centres], x)[0]
    owner = np.zeros(len(x), np.int64)
    while most is None or len(centres) < most:
        left = np.flatnonzero(best > radius * radius)[:64]
        if not len(left):
            break
        d = _squared(x[left], x[left])
        new = [0]
        for k in range(1, len(left)):
            if d[k, new].min() > radius * radius:
                new.append(k)
        new = new[: None if most is None else most - len(centres)]
        to = _squared(x[left[new]], x)
        near = to.argmin(axis=0)
        value = to[near, np.arange(len(x))]
        closer = value < best
        best[closer], owner[closer] = value[closer], near[closer] + len(centres)
        centres = np.append(centres, left[new])
    return centres, owner


def build_levels(x: np.ndarray, leaf: float = LEAF_RADIUS) -> list[dict[str, np.ndarray]]:
    """Nested levels over x, coarsest first: centres (rows of x), parents, members' nodes, covering radii.

    The radius halves from 1 to ``leaf``. A level's centres include those of the level above, and each new one
    is beyond the radius of the others below the same parent. The last level is the vectors.
    """
    n = len(x)
    levels = [{"centre": np.zeros(1, np.int64), "node": np.zeros(n, np.int64)}]
    radius = 1.0
    while radius >= leaf and len(levels[-1]["centre"]) < n:
        above = levels[-1]
        centre, node, count = [], np.empty(n, np.int64), 0
        order = np.argsort(above["node"], kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(above["node"][order])) + 1):
            own = int(np.flatnonzero(members == above["centre"][above["node"][members[0]]])[0])
            chosen, owner = separated(x[members], radius, own) if len(members) > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))
            centre.append(members[chosen])
            node[members] = owner + count
            count += len(chosen)
        levels.append({"centre": np.concatenate(centre), "node": node})
        radius /= 2
    if len(levels[-1]["centre"]) == n and len(levels) > 1:
        levels.pop()
    levels.append({"centre": np.arange(n), "node": np.arange(n)})
    # a level that hardly coarsens the one below it prunes next to nothing: it is left implicit
    kept = [levels[-1]]
    for level in levels[-2:0:-1]:
        if len(level["centre"]) * 1.5 <= len(kept[-1]["centre"]):
            kept.append(level)
    levels = [levels[0], *kept[::-1]] if n > 1 else levels[:1]
    for k, level in enumerate(levels):
        at = x[level["centre"]]
        d = np.sqrt(np.maximum(((x - at[level["node"]]) ** 2).sum(1), 0))
        level["radius"] = np.zeros(len(at))
        np.maximum.at(level["radius"], level["node"], d)
        level["parent"] = levels[k - 1]["node"][level["centre"]] if k else np.zeros(1, np.int64)
    return levels


def dual_traversal(x: np.ndarray, y: np.ndarray, tx: list, ty: list, reach: float, same: bool, most: int = 2 << 20):
    """Yields (i, j, product): rows of x and y whose distance may be within reach, and their inner product, a strip at
    a time; all that are within reach are among them.

    A level's node pairs are held as a bit a pair; the last level is only ever held in strips of about ``most`` pairs.
    """
    depth = max(len(tx), len(ty))
    alive = np.ones((1, 1), bool)
    if depth == 1:
        if not same:
            yield np.zeros(1, np.int64), np.zeros(1, np.int64), x[0] @ y[:1].T
        return
    for level in range(1, depth):
        a, b = tx[min(level, len(tx) - 1)], ty[min(level, len(ty) - 1)]
        na, nb = len(a["centre"]), len(b["centre"])
        up_a, up_b = (a["parent"] if level < len(tx) else np.arange(na)), (b["parent"] if level < len(ty) else np.arange(nb))
        last = level == depth - 1
        below = None if last else np.zeros((na, nb), bool)
        whole = alive.all()
        ca, cb = x[a["centre"]], y[b["centre"]]
        block = max(1, most // max(nb, 1))
        for start in range(0, na, block):
            part = np.arange(start, min(start + block, na))
            rows = None if whole else alive[up_a[part]]
            cols = np.arange(nb) if whole else np.flatnonzero(rows.any(axis=0)[up_b])
            if last and same:
                cols = cols[cols > start]
            if not len(cols):
                continue
            # for centres of length 1, a bound on the distance is one on the inner product
            wide = reach + SLACK if last else a["radius"][part][:, None] + b["radius"][cols][None, :] + (reach + SLACK)
            product = ca[part] @ cb[cols].T
            hit = product >= np.float32(1 - wide * wide / 2) if last else product >= (1 - np.minimum(wide, 2.0) ** 2 / 2 - SLACK).astype(np.float32)
            if not whole:
                hit &= rows[:, up_b[cols]]
            if not last:
                below[part[:, None], cols] = hit
                continue
            i, j = np.nonzero(hit)
            about = product[i, j]
            i, j = a["centre"][part[i]], b["centre"][cols[j]]
            if same:
                keep = i < j
                i, j, about = i[keep], j[keep], about[keep]
            if len(i):
                yield i, j, about
        alive = below
        if not last and not alive.any():
            return


def _usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _items(embeddings: DataFrame) -> DataFrame:
    """(id, v, key, fine): the rows, a 128-bit key of the vector, and whether it can have links."""
    v = F.col("embedding")
    key = F.concat(F.hex(F.xxhash64(v)), F.lit("-"), F.hex(F.xxhash64(F.lit(77), v, F.size(v))))
    return embeddings.select(F.col("vec_id").alias("id"), v.alias("v"), key.alias("key"), (F.col("vec_id").isNotNull() & _usable(v.cast("array<double>"))).alias("fine"))


def _unit(x: np.ndarray) -> np.ndarray:
    # the largest part first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(rows, dim: int) -> np.ndarray:
    return _unit(matrix(rows, dim))


def _grown(x: np.ndarray, weight: float, cell: int, radius: float = 1.0):
    """The top of the tree over x, of which each row stands for ``weight`` vectors: (centres, what is below each), or None for a cell."""
    if len(x) * weight <= cell or radius < LEAF_RADIUS:
        return None
    at, owner = separated(x, radius, most=min(FANOUT, math.ceil(2 * len(x) * weight / cell)))
    if len(at) == 1:
        return _grown(x, weight, cell, radius / 2)
    return x[at], [_grown(x[owner == k], weight, cell, radius / 2) for k in range(len(at))]


def _numbered(top, count):
    """The same with a number for each cell, along the tree."""
    return next(count) if top is None else (top[0], [_numbered(below, count) for below in top[1]])


def _routed(x: np.ndarray, top) -> np.ndarray:
    """The number of the cell of each row of x."""
    out, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), top)]
    while todo:
        rows, top = todo.pop()
        if isinstance(top, int):
            out[rows] = top
            continue
        at = _squared(x[rows], top[0]).argmin(axis=1)
        todo += [(rows[at == k], top[1][k]) for k in np.unique(at).tolist()]
    return out


def _tops(vectors: DataFrame, cell: int) -> dict:
    """The top of the tree of each dimension that has more than a cell of vectors."""
    large = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    share = DRAWN / max(1, sum(4 * d * n for d, n in large.items()))
    wanted = {d: max(2.0, min(16.0 * n / cell, share * n)) for d, n in large.items()}
    tops = {}
    for d, n in large.items():
        # by hash, so that the same vectors are drawn again
        drawn = vectors.filter((F.col("dim") == d) & (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n)) < F.lit(math.ceil(wanted[d]))))
        pdf = drawn.select("key", "v").toPandas().sort_values("key")
        if len(pdf):
            tops[d] = _numbered(_grown(_vectors(pdf["v"], d), n / len(pdf), cell), itertools.count())
    return tops


def _cells(nodes: DataFrame, cell: int) -> DataFrame:
    """(name, dim, centre, radius, keys, w, x, tree): the vectors by cells, to be written a row a file."""
    packed = as_bytes(nodes.select("key", "w", "v", F.size("v").alias("dim")))
    vectors = materialise(packed, "vectors")
    tops = _tops(vectors, cell)

    def route(batches):
        for batch in batches:
            dim, node = batch.column("dim").to_numpy(), np.zeros(len(batch), np.int64)
            for d in np.unique(dim).tolist():
                if d in tops:
                    rows = np.flatnonzero(dim == d)
                    node[rows] = _routed(_vectors(batch.column("v").take(pa.array(rows)).to_pylist(), d), tops[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=[*batch.schema.names, "node"])

    routed = vectors.mapInArrow(route, "key string, w bigint, v binary, dim int, node bigint")
    crowd = routed.groupBy("dim", "node").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    placed = routed.join(F.broadcast(crowd), ["dim", "node"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        dim, node, part = (int(pdf[c].iloc[0]) for c in ("dim", "node", "part"))
        x = _vectors(pdf["v"], dim)
        centre, kind = x.mean(axis=0), np.uint16 if len(x) <= 1 << 16 else np.int64
        tree = [(level["centre"].astype(kind), level["parent"].astype(kind), np.nextafter(level["radius"].astype(np.float32), np.float32(np.inf))) for level in build_levels(x.astype(np.float32))]
        return pd.DataFrame({"name": [f"{node:012}/{part:06}"], "dim": [dim], "centre": [centre.tobytes()], "radius": [float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))], "keys": ["\n".join(pdf["key"])],
                             "w": [pdf["w"].to_numpy(np.int64).tobytes()], "x": [b"".join(pdf["v"])], "tree": [pickle.dumps(tree)]})

    return placed.groupBy("dim", "node", "part").applyInPandas(cover, "name string, dim int, centre binary, radius double, keys string, w binary, x binary, tree binary")


def _read(uri: str) -> list[dict]:
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        return pq.ParquetFile(f).read().to_pylist()


def _open(uri: str) -> tuple:
    """Vectors, keys, weights, levels and single-precision vectors of a cell."""
    (r,) = _read(uri)
    w = np.frombuffer(r["w"], np.int64)
    kind = np.float32 if len(r["x"]) == 4 * r["dim"] * len(w) else np.float64
    x = _unit(np.frombuffer(r["x"], kind).reshape(len(w), -1).astype(np.float64))
    tree = [{"centre": centre.astype(np.int64), "parent": parent.astype(np.int64), "radius": radius} for centre, parent, radius in pickle.loads(r["tree"])]
    return x, np.array(r["keys"].split("\n"), object), w, tree, x.astype(np.float32)


def _hits(a: tuple, b: tuple, min_cosine: float):
    """Yields (i, j), vectors of the cells a and b with a cosine of at least min_cosine, each pair once if they are one."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    sure = 1e-5 + 2e-7 * a[0].shape[1]
    for i, j, about in dual_traversal(a[4], b[4], a[3], b[3], reach, a is b):
        keep = about >= min_cosine + sure
        close = np.flatnonzero(~keep & (about >= min_cosine - sure))
        for at in range(0, len(close), 65_536):
            part = close[at : at + 65_536]
            keep[part] = np.einsum("ij,ij->i", a[0][i[part]], b[0][j[part]]) >= min_cosine
        if keep.any():
            yield i[keep], j[keep]


def _meetings(task: int, heads: list[dict], size: int, strips: int, reach: float) -> dict[int, list[int]]:
    """The cells that a task reads, each with those of its own group that are within reach of it; over all tasks, every
    pair of cells that the covering radii don't rule out comes once.

    A group meets itself and the half of the others that follows it, in a circle, so that all have the same to do."""
    groups = math.ceil(len(heads) / size)
    g, strip = divmod(task, strips)
    mine = range(g * size, min((g + 1) * size, len(heads)))
    met: dict[int, list[int]] = {}
    ahead = [d for d in range(strip + 1, groups // 2 + 1, strips) if 2 * d < groups or g < groups // 2]
    others = np.array([j for d in ahead for j in range((g + d) % groups * size, min(((g + d) % groups + 1) * size, len(heads)))] + (list(mine) if strip == 0 else []), np.int64)
    dims = np.array([heads[j]["dim"] for j in others])
    for i in mine:
        js = others[(dims == heads[i]["dim"]) & ((others < mine.start) | (others >= mine.stop) | (others > i))] if len(others) else others
        if len(js):
            d = np.sqrt(_squared(np.frombuffer(heads[i]["centre"])[None, :], np.array([np.frombuffer(heads[j]["centre"]) for j in js])))[0]
            for j in js[d <= heads[i]["radius"] + np.array([heads[j]["radius"] for j in js]) + reach + SLACK].tolist():
                met.setdefault(j, []).append(i)
        if strip == 0:
            met.setdefault(i, []).append(i)
    return met


def _over_cells(nodes: DataFrame, min_cosine: float, cell: int, each, schema: str) -> DataFrame:
    """What ``each`` gives for the cells a and b and the (i, j) of their near vectors, for every pair of cells within reach."""
    spark, reach = nodes.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    cells = materialise_step(lambda: _cells(nodes, cell), "cells", rows_a_file=1)
    listed = materialise(cells.select("name", "dim", "centre", "radius", F.col("_metadata.file_path").alias("file")).repartition(1).sortWithinPartitions("dim", "name"), "cell-heads")
    n, widest = listed.agg(F.count("*"), F.max("dim")).first()
    where = [r[0] for r in listed.select("_metadata.file_path").distinct().collect()]
    size = max(1, min(HOLD, HELD // (12 * cell * (widest or 1)), n // 128))
    groups = math.ceil(n / size)
    strips = max(1, math.ceil(groups * size / 2 / STRIP))

    def compare(batches):
        heads = None
        for batch in batches:
            for task in batch["id"].tolist():
                heads = heads or [r for uri in where for r in _read(uri)]
                held: dict[int, tuple] = {}
                for j, near in sorted(_meetings(task, heads, size, strips, reach).items()):
                    for i in near:
                        if i not in held:
                            held[i] = _open(heads[i]["file"])
                    b = held[j] if j in held else _open(heads[j]["file"])
                    for i in near:
                        found = each(held[i], b, _hits(held[i], b, min_cosine))
                        if len(found):
                            yield found

    return spark.range(0, groups * strips, 1, max(1, min(groups * strips, TASKS))).mapInPandas(compare, schema)


def _nodes(own: DataFrame) -> DataFrame:
    """(key, w, v): the distinct vectors that can have links; w is the number of their distinct ids."""
    return own.filter("fine").groupBy("key").agg(F.count_distinct("id").alias("w"), F.any_value("v").alias("v"))


def near_classes(embeddings: DataFrame, min_cosine: float = MIN_COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id, class_id, links) of every distinct item."""
    with swept(embeddings.sparkSession):
        return _near_classes(embeddings, min_cosine, cell)


def _near_classes(embeddings: DataFrame, min_cosine: float, cell: int) -> DataFrame:
    own = _items(embeddings)
    members = materialise(own.select("id", F.when(F.col("fine"), F.col("key")).otherwise(F.concat(F.lit("-"), "key", F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("key"), "fine").distinct(), "items")
    weights = members.filter("fine").groupBy("key").agg(F.count("*").alias("w"))
    nodes = own.filter("fine").groupBy("key").agg(F.any_value("v").alias("v")).join(weights, "key")

    def links(a: tuple, b: tuple, hits) -> pd.DataFrame:
        same = a is b
        n, m = len(a[1]), 0 if same else len(b[1])
        label, got = np.arange(n + m), np.zeros(n + m, np.int64)
        shift = 0 if same else n
        for i, j in hits:
            j = j + shift
            got += np.bincount(i, weights=b[2][j - shift], minlength=n + m).astype(np.int64) + np.bincount(j, weights=a[2][i], minlength=n + m).astype(np.int64)
            local_roots(label, i, j)
        keys = a[1] if same else np.concatenate([a[1], b[1]])
        some = np.flatnonzero(got)
        return pd.DataFrame({"key": keys[some], "links": got[some], "root": keys[label[some]]})

    found = materialise_step(lambda: _over_cells(nodes, min_cosine, cell, links, "key string, links bigint, root string"), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("near"))
    roots = star_roots(found.filter("key <> root").select(F.col("key").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("id", "key")
    each = members.join(weights, "key", "left").join(counts, "key", "left").join(roots, "key", "left")
    each = each.select("id", F.coalesce("root", "key").alias("class"), (F.coalesce(F.col("w") - 1, F.lit(0)) + F.coalesce("near", F.lit(0))).alias("links"))
    names = each.groupBy("class").agg(F.min("id").alias("class_id"))
    return each.join(names, "class").select(F.col("id").alias("vec_id"), "class_id", "links")


def near_pairs(embeddings: DataFrame, min_cosine: float = MIN_COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id_a, vec_id_b, cosine) of all pairs of at least min_cosine: as many rows as there are pairs."""
    own = _items(embeddings).filter("fine")
    members = materialise(own.select("id", "key").distinct(), "items")

    def pairs(a: tuple, b: tuple, hits) -> pd.DataFrame:
        parts = [pd.DataFrame({"k": a[1][i], "l": b[1][j], "cosine": np.einsum("ij,ij->i", a[0][i], b[0][j])}) for i, j in hits]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["k", "l", "cosine"])

    found = _over_cells(_nodes(own), min_cosine, cell, pairs, "k string, l string, cosine double")
    alike = members.select(F.col("key").alias("k"), F.col("key").alias("l"), F.lit(1.0).alias("cosine")).distinct()
    left, right = members.select(F.col("id").alias("p"), F.col("key").alias("k")), members.select(F.col("id").alias("q"), F.col("key").alias("l"))
    listed = found.unionByName(alike).join(left, "k").join(right, "l").filter((F.col("p") < F.col("q")) | ((F.col("k") != F.col("l")) & (F.col("p") > F.col("q"))))
    ends = listed.select(F.least("p", "q").alias("vec_id_a"), F.greatest("p", "q").alias("vec_id_b"), "cosine")
    return ends.groupBy("vec_id_a", "vec_id_b").agg(F.round(F.max("cosine"), 6).alias("cosine"))


def op5_cover_tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, class_id and the number of links of every item, at a cosine of 0.95."""
    return near_classes(table(spark, sf_dir, "embeddings"))


def near_vectors_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a cosine of 0.45, which the vectors of the small tables reach as well."""
    return near_classes(table(spark, sf_dir, "embeddings"), 0.45)


def _sql(least: float) -> str:
    return f"""
WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {least}),
r AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.other)
SELECT id AS vec_id, min(other) AS class_id, (SELECT count(*) FROM p WHERE p.a = id) AS links FROM r GROUP BY id
"""


SQL = _sql(MIN_COSINE)
SQL_LOOSE = _sql(0.45)
