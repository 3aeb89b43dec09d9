"""Comparison and truth in the query language: two-valued, with NULL equal to NULL and below everything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(t, T.NullType):
        return "null"
    return t.typeName()


def comparable(a: str, b: str) -> bool:
    return a == b or "null" in (a, b) or {a, b} == {"time", "string"}


def compare(op: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType, a_set: bool = False, b_set: bool = False) -> Column:
    """Always true or false. ``a_set`` and ``b_set`` tell that a side can't be NULL, which keeps the test plain
    enough for the scan to take over. Values of different kinds are unequal, yet neither is below the other."""
    ka, kb = kind(ta), kind(tb)
    if not comparable(ka, kb):
        both_null = a.isNull() & b.isNull()
        below, above = a.isNull() & b.isNotNull(), a.isNotNull() & b.isNull()
        return {"=": both_null, "<>": ~both_null, "<": below, ">": above, "<=": ~above, ">=": ~below}[op]
    if op == "=":
        return a.eqNullSafe(b)
    if op == "<>":
        return ~a.eqNullSafe(b)
    if op in (">", ">="):
        a, b, a_set, b_set, op = b, a, b_set, a_set, {">": "<", ">=": "<="}[op]
    # from here a < b or a <= b
    if op == "<":
        if a_set and b_set:
            return a < b
        if b_set:
            return (a < b) | a.isNull()
        if a_set:
            return b.isNotNull() & (a < b)
        return b.isNotNull() & (a.isNull() | (a < b))
    if a_set and b_set:
        return a <= b
    if b_set:
        return (a <= b) | a.isNull()
    if a_set:
        return b.isNotNull() & (a <= b)
    return a.isNull() | (b.isNotNull() & (a <= b))


def truthy(c: Column, t: T.DataType) -> Column:
    k = kind(t)
    if k == "bool":
        return F.coalesce(c, F.lit(False))
    if k == "number":
        return F.coalesce(c != 0, F.lit(False))
    if k == "string":
        return F.coalesce(c != "", F.lit(False))
    if k in ("array", "map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()
