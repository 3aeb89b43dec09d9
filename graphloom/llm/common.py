"""What the operators of this folder have in common."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def local_roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of nodes i and j, pair by pair; ``label`` leads every node to the least node of its set."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def words(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def mixed_key(df: DataFrame, name: str) -> Column:
    """A fixed scrambling of an id into [0, 2^32) that any SQL engine can repeat; NULL counts as 0, and text by its hash."""
    whole = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(name).cast("bigint") if whole else F.when(F.col(name).isNotNull(), F.xxhash64(name))
    positive = F.pmod(F.coalesce(number, F.lit(0)), F.lit(2147483648))
    return (positive * F.lit(2654435761)) % F.lit(4294967296)


MIXED_KEY_SQL = "(((((coalesce(doc_id, 0) % 2147483648) + 2147483648) % 2147483648) * 2654435761) % 4294967296)"
