"""Exact vector search, quantisation, and search over shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import cosine, dot, euclid
from graphloom.operators.blocks import as_bytes, blocked, matrix
from graphloom.storage import materialise, materialise_at, shuffled


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Larger is nearer for every metric: the distance counts with a minus sign."""
    if metric == "cosine":
        return cosine(a, b)
    if metric in ("dot", "dot_product"):
        return dot(a, b)
    if metric in ("euclid", "euclidean", "l2"):
        return -euclid(a, b)
    raise ValueError(f"unknown metric {metric}")


def _query(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(vectors: DataFrame, vector: list[float], k: int, metric: str = "cosine", but: int | None = None) -> DataFrame:
    """(id, similarity) of the k nearest of vectors (id, v): one scan, and the k best of each task."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = vectors if but is None else vectors.filter(F.col("id") != but)
    scored = rows.select("id", similarity(metric, F.col("v"), _query(vector)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Similarity of every row of q to every row of x; a vector without length has cosine 0."""
    if metric == "cosine":
        lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(q @ x.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
    if metric in ("dot", "dot_product"):
        return q @ x.T
    if metric in ("euclid", "euclidean", "l2"):
        # by differences, a strip of dimensions at a time: the product form loses digits between near vectors
        out = np.zeros((len(q), len(x)))
        for d in range(q.shape[1]):
            out += (q[:, d : d + 1] - x[None, :, d]) ** 2
        return -np.sqrt(out)
    if metric == "hamming":
        a, b = np.where(q >= 0, 1.0, -1.0), np.where(x >= 0, 1.0, -1.0)
        return (a @ b.T - q.shape[1]) / 2
    raise ValueError(f"unknown metric {metric}")


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query, id, similarity): the k nearest vectors, but itself, of each query (id, v); ties by the smaller id.

    Queries and vectors meet in blocks: a block of queries and one of vectors make a matrix product, of which the k
    best of each query go on. So what is shuffled is blocks times blocks and k rows a query and block, and no
    pair is ever a row. Vectors of another dimension are not compared. ``hamming`` compares the signs of the parts.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if metric not in ("cosine", "dot", "dot_product", "euclid", "euclidean", "l2", "hamming"):
        raise ValueError(f"unknown metric {metric}")
    q = materialise(blocked(queries).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x")), "query-blocks")
    x = materialise(blocked(vectors), "vector-blocks")
    tasks = max(1, min(q.count() * x.count(), 100_000))
    met = q.join(x, "dim").repartition(tasks, "q_block", "block")

    def nearest(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = np.frombuffer(r.q_x).reshape(-1, r.dim), np.frombuffer(r.x).reshape(-1, r.dim)
                qs, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                by_id = np.argsort(ids, kind="stable")
                b, ids = b[by_id], ids[by_id]
                for at in range(0, len(a), 512):
                    s = _scores(metric, a[at : at + 512], b)
                    s[qs[at : at + 512, None] == ids[None, :]] = -np.inf
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(s, best, axis=1)
                    keep = value > -np.inf
                    yield pd.DataFrame({"query": np.repeat(qs[at : at + 512], keep.sum(1)), "id": ids[best[keep]], "similarity": value[keep]})

    found = met.mapInPandas(nearest, "query bigint, id bigint, similarity double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def sharded_knn(vectors: DataFrame, vector: list[float], k: int, shards: int, metric: str = "cosine") -> DataFrame:
    """Scatter and gather: the k best of each shard, then the k best of those. As exact as knn."""
    scored = vectors.select("id", F.pmod("id", F.lit(shards)).alias("shard"), similarity(metric, F.col("v"), _query(vector)).alias("similarity"))
    local = F.row_number().over(W.partitionBy("shard").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("place", local).filter(F.col("place") <= k).orderBy(F.desc("similarity"), "id").limit(k).select("id", "shard", "similarity")


def quantise(v: Column) -> Column:
    """Struct (low, high, codes): each part as one of 255 steps between the vector's smallest and largest part."""
    x = v.cast("array<double>")
    low, high = F.array_min(x), F.array_max(x)
    step = F.when(high > low, (high - low) / 255).otherwise(F.lit(1.0))
    return F.struct(low.alias("low"), high.alias("high"), F.transform(x, lambda y: F.floor((y - low) / step + 0.5).cast("int")).alias("codes"))


def dequantise(q: Column) -> Column:
    step = F.when(q["high"] > q["low"], (q["high"] - q["low"]) / 255).otherwise(F.lit(1.0))
    return F.transform(q["codes"], lambda c: q["low"] + c * step)


def signs(v: Column) -> Column:
    """One bit a part: whether it is not negative."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def memory(vectors: DataFrame) -> DataFrame:
    """count, dimension, and bytes as floats, 8-bit codes and bits."""
    n, d = F.count("*"), F.max(F.size("v"))
    return vectors.agg(n.alias("vectors"), d.cast("bigint").alias("dimension"), F.sum(F.size("v") * 4).alias("float_bytes"), F.sum(F.size("v") + 8).alias("int8_bytes"), F.sum(F.ceil(F.size("v") / 8)).alias("binary_bytes"))


def ivf(vectors: DataFrame, cells: int, seed: int = 1, fit_rows: int = 100_000):
    """(model, vectors with their cell): an inverted file whose cells are k-means clusters.

    The centres are fitted on the ``fit_rows`` vectors whose ids hash lowest; every vector is filed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))
    sample = ready.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell", maxIter=10).fit(sample)
    return model, model.transform(ready).drop("features")


def ivf_search(model, filed: DataFrame, vector: list[float], k: int, probes: int, metric: str = "cosine") -> DataFrame:
    """The k nearest of the vectors in the ``probes`` cells whose centres are nearest to the query."""
    near = sorted(range(len(model.clusterCenters())), key=lambda c: sum((a - b) ** 2 for a, b in zip(model.clusterCenters()[c], vector, strict=True)))[:probes]
    return knn(filed.filter(F.col("cell").isin(near)), vector, k, metric)


#: Vectors of a cell that are compared at once, and queries that meet them.
UNIT, ASKED = 65_536, 1024


def _unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' lengths, and the rows at length 1 in single precision; one without length stays zero."""
    squares = np.zeros(len(x))
    for d in range(x.shape[1]):
        squares += x[:, d] * x[:, d]
    length = np.sqrt(squares)
    return length, np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0).astype(np.float32)


def _exact(q: np.ndarray, q_length: np.ndarray, x: np.ndarray, x_length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of the pairs (i, j), part after part, so that equal vectors have equal ones wherever they stand."""
    dot_, norm = np.zeros(len(i)), q_length[i] * x_length[j]
    for d in range(q.shape[1]):
        dot_ += q[i, d] * x[j, d]
    return np.divide(dot_, norm, out=np.zeros_like(dot_), where=norm > 0)


def _best(i: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest values of each i are; ties by the smaller id."""
    order = np.lexsort((ids, -value, i))
    first = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < k]


def _nearest_in(qid: np.ndarray, q: np.ndarray, low: np.ndarray, ids: np.ndarray, x: np.ndarray, x_length: np.ndarray, x_one: np.ndarray, k: int):
    """(i, id, similarity): for each query, the k nearest of x but itself whose similarity is at least ``low``.

    Products in single precision tell which pairs can be among them; those are worked out in double precision.
    """
    q_length, q_one = _unit_rows(q)
    sure = 1e-5 + 2e-7 * q.shape[1]
    at, found, value, least = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), low.copy()
    for a in range(0, len(ids), 8192):
        s = q_one @ x_one[a : a + 8192].T
        bar = least - sure
        if s.shape[1] > k + 1:
            # the k + 1st of these is no better than the kth but itself
            slow = np.flatnonzero(np.isneginf(least))
            bar[slow] = np.partition(s[slow], s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - sure
        i, j = np.nonzero(s >= bar[:, None])
        j += a
        other = qid[i] != ids[j]
        i, j = i[other], j[other]
        if not len(i):
            continue
        exact = _exact(q, q_length, x, x_length, i, j)
        keep = exact >= low[i]
        at, found, value = np.r_[at, i[keep]], np.r_[found, ids[j[keep]]], np.r_[value, exact[keep]]
        best = _best(at, found, value, k)
        at, found, value = at[best], found[best], value[best]
        full = np.flatnonzero(np.bincount(at, minlength=len(q)) >= k)
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, at, value)
        least[full] = worst[full]
    return at, found, value


def _queries_of(path: str, cell: int):
    """Yields (ids, vectors, lows) of the stored queries that read a cell, some at a time."""
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    for f in files.get_file_info(pyarrow.fs.FileSelector(root)):
        if not f.base_name.endswith(".parquet"):
            continue
        with files.open_input_file(f.path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(ASKED, columns=["query", "q", "low", "need"]):
                need = batch.column("need")
                rows = np.repeat(np.arange(len(batch)), need.value_lengths().to_numpy(zero_copy_only=False))
                rows = np.unique(rows[need.flatten().to_numpy(zero_copy_only=False) == cell])
                if len(rows):
                    some = batch.take(pa.array(rows))
                    q = some.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                    yield some.column("query").to_numpy(), q, some.column("low").to_numpy().copy()


def _read_cells(asked: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity): the k nearest in each unit (cell, dim, ids, x) of the cells that a query needs.

    ``asked`` has query, q, low (no less similar one counts) and need, the cells. It is written, and each unit's task reads
    the queries of its cell from there: neither is sent to all of the other, and no pair is a row.
    """
    path = materialise_at(asked.select("query", F.col("q").cast("array<double>").alias("q"), "low", "need"), "asked")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                x = matrix([r.x], r.dim, len(ids))
                x_length, x_one = _unit_rows(x)
                for qid, q, low in _queries_of(path, r.cell):
                    at, found, value = _nearest_in(qid, q, low, ids, x, x_length, x_one, k)
                    if len(at):
                        yield pd.DataFrame({"query": qid[at], "id": found, "similarity": value})

    return units.mapInPandas(run, "query bigint, id bigint, similarity double")


def _units(at: DataFrame) -> DataFrame:
    """(cell, dim, ids, x): the vectors (id, v, cell) of each cell in units of about ``UNIT``, one for each task."""
    parts = at.groupBy("cell").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts"))
    rows = at.join(F.broadcast(parts), "cell").select("id", "v", "cell", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "dim": pdf["dim"].iloc[:1], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "x": [b"".join(pdf["v"])]})

    units = materialise(as_bytes(rows).groupBy("cell", "part").applyInPandas(pack, "cell int, dim int, ids binary, x binary"), "units")
    return units.repartition(max(1, min(units.count(), 100_000)))


def ivf_join(model, filed: DataFrame, k: int, asking: Column | None = None) -> DataFrame:
    """(query, id, similarity): the k nearest by cosine, but itself, of every filed vector, or of those that
    ``asking`` (over id) holds for; as exact as knn_join.

    Cells are kept as the range of angles of their members to their centre. A query first reads the cells nearest
    to it that together hold k others; the angle of its k-th there bounds the rest. By the triangle inequality a
    cell farther off than that bound from its outermost member has no nearer vector and is not read. Queries and
    vectors of a cell are compared as matrix products.
    """
    centres = np.array(model.clusterCenters())
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    @F.arrow_udf("array<double>")
    def angles(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        to = np.arccos(np.clip(np.divide(x @ centres.T, length, out=np.zeros((len(x), len(centres))), where=length > 0), -1, 1))
        return pa.ListArray.from_arrays(np.arange(0, to.size + 1, len(centres), dtype=np.int32), pa.array(to.ravel()))

    at = materialise(filed.select("id", "v", "cell", angles("v").alias("to")), "filed")
    shape = {r["cell"]: (r["r"], r["n"]) for r in at.groupBy("cell").agg(F.max(F.element_at("to", F.col("cell") + 1)).alias("r"), F.count("*").alias("n")).collect()}
    cells = F.array(*[F.struct(F.element_at("to", c + 1).alias("far"), F.lit(c).alias("cell"), F.lit(float(r)).alias("r"), F.lit(n).alias("n")) for c, (r, n) in shape.items()])
    order = (at if asking is None else at.filter(asking)).withColumn("cells", F.array_sort(cells))
    before = lambda x, i: F.aggregate(F.slice("cells", 1, i), F.lit(0).cast("bigint"), lambda s, y: s + y["n"])
    # one more than k, as the query itself may be among them
    asked = order.withColumn("near", F.filter("cells", lambda x, i: before(x, i) <= k)).select("id", "v", "cells", "near")
    units = _units(at.select(F.col("id").cast("bigint").alias("id"), "v", "cell"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    as_query = (F.col("id").cast("bigint").alias("query"), F.col("v").alias("q"))

    near = _read_cells(asked.select(*as_query, F.lit(float("-inf")).alias("low"), F.col("near.cell").alias("need")), units, k)
    first = materialise(near.withColumn("place", place).filter(F.col("place") <= k).drop("place"), "nearest")
    bound = first.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("low"))
    known = shuffled(asked.select(*as_query, "cells", "near")).join(bound, "query", "left").withColumn("full", F.coalesce("n", F.lit(0)) >= k)
    limit = F.when(F.col("full"), F.acos(F.greatest(F.least("low", F.lit(1.0)), F.lit(-1.0)))).otherwise(F.lit(4.0))
    others = F.filter("cells", lambda x: ~F.array_contains(F.col("near.cell"), x["cell"]) & (x["far"] - x["r"] <= F.col("limit") + 1e-6))
    rest = known.withColumn("limit", limit).select("query", "q", F.when(F.col("full"), F.col("low")).otherwise(F.lit(float("-inf"))).alias("low"), F.transform(others, lambda x: x["cell"]).alias("need"))
    all_ = first.unionByName(_read_cells(rest.filter(F.size("need") > 0), units, k))
    return all_.withColumn("place", place).filter(F.col("place") <= k).drop("place")
