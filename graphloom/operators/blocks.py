"""Vectors packed into blocks, so that many meet many as matrix products in Arrow batches, never row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; a task holds a few blocks at a time, whatever the size of the table.
BLOCK = 4096


def as_bytes(df: DataFrame, v: str = "v") -> DataFrame:
    """``df`` with the vectors as bytes of their floats or doubles, taken from the batch's buffer as a whole."""
    schema = ", ".join(f"`{c}` {'binary' if c == v else t}" for c, t in df.dtypes)
    at = df.columns.index(v)

    def run(batches):
        for batch in batches:
            x = batch.column(at)
            flat = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False))
            off = (x.offsets.to_numpy() - x.offsets[0].as_py()).astype(np.int32) * flat.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([packed if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def matrix(rows, dim: int, each: int = 1) -> np.ndarray:
    """The vectors as rows of doubles; a row of bytes has ``each`` of them."""
    rows = list(rows)
    kind = np.float32 if rows and len(rows[0]) == 4 * dim * each else np.float64
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)


def blocked(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(dim, block, ids, x): the vectors (id bigint, v array<double>) of one dimension in blocks of about ``size``.

    The number of blocks follows from the count of rows, so a block never outgrows its task.
    """
    plain = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    parts = plain.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    rows = as_bytes(plain.withColumn("dim", F.size("v")).join(parts, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "x": [b"".join(pdf["v"])]})

    return rows.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, x binary")
