"""Scalar functions of the query language as Spark expressions. Each takes columns and their types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.semantics import kind



def _strings(f: Callable[..., Column]) -> Callable:
    """Gives NULL unless all the arguments are strings."""

    def run(args: list[Column], types: list[T.DataType]) -> Column:
        if any(kind(t) not in ("string", "null") for t in types):
            return F.lit(None)
        return f(*args)

    return run


def _any(f: Callable[..., Column]) -> Callable:
    return lambda args, types: f(*args)


def _split(args, types):
    if any(kind(t) not in ("string", "null") for t in types):
        return F.lit(None)
    text, cut = args
    return F.when(cut == "", F.concat(F.array(F.lit("")), F.split(text, "", -1), F.array(F.lit("")))).otherwise(F.split(text, F.concat(F.lit(r"\Q"), cut, F.lit(r"\E")), -1))


def _to_integer(args, types):
    k = kind(types[0])
    if k == "string":
        return F.when(args[0].rlike(r"^[+-]?[0-9]+$"), args[0].try_cast("bigint"))
    if k == "number":
        return args[0].try_cast("bigint")
    return F.lit(None).cast("bigint")


def _to_float(args, types):
    k = kind(types[0])
    if k == "string":
        return F.when(args[0].rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), args[0].try_cast("double"))
    return args[0].try_cast("double") if k == "number" else F.lit(None).cast("double")


def _to_boolean(args, types):
    k = kind(types[0])
    if k == "bool":
        return args[0]
    if k == "string":
        return F.when(args[0] == "true", F.lit(True)).when(args[0] == "false", F.lit(False))
    return F.lit(None).cast("boolean")


def _substring(args, types):
    text, start = args[0], args[1]
    if len(args) == 3:
        return F.substr(text, start + 1, args[2])
    return F.substr(text, start + 1)


def _size(args, types):
    return (F.length(args[0]) if kind(types[0]) == "string" else F.size(args[0])).cast("bigint")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; 0 if either has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(squares(x)) * F.sqrt(squares(y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.try_divide(dot(x, y), norm))


def squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


FUNCTIONS: dict[str, Callable] = {
    "coalesce": _any(F.coalesce),
    "tolower": _strings(F.lower),
    "lower": _strings(F.lower),
    "toupper": _strings(F.upper),
    "upper": _strings(F.upper),
    "contains": _strings(F.contains),
    "startswith": _strings(F.startswith),
    "endswith": _strings(F.endswith),
    "split": _split,
    "tostring": _any(lambda x: x.cast("string")),
    "tointeger": _to_integer,
    "tofloat": _to_float,
    "toboolean": _to_boolean,
    "date": lambda args, types: args[0].try_cast("date") if args else F.current_date(),
    "datetime": lambda args, types: args[0].try_cast("timestamp_ntz") if args else F.localtimestamp(),
    "length": lambda args, types: (F.length(args[0]) if kind(types[0]) == "string" else F.size(args[0]) - 1).cast("bigint"),
    "size": _size,
    "head": _any(lambda x: F.try_element_at(x, F.lit(1))),
    "last": _any(lambda x: F.try_element_at(x, F.lit(-1))),
    "reverse": _any(F.reverse),
    "range": _any(F.sequence),
    "nodes": _any(lambda p: p),
    "trim": _strings(F.trim),
    "ltrim": _strings(F.ltrim),
    "rtrim": _strings(F.rtrim),
    "replace": _strings(F.replace),
    "substring": _substring,
    "left": _any(F.left),
    "right": _any(F.right),
    "abs": _any(F.abs),
    "ceil": _any(F.ceil),
    "floor": _any(F.floor),
    "round": lambda args, types: F.round(args[0], args[1] if len(args) > 1 else F.lit(0)),
    "sign": _any(F.sign),
    "sqrt": _any(F.sqrt),
    "log": _any(F.ln),
    "log10": _any(F.log10),
    "exp": _any(F.exp),
    "rand": lambda args, types: F.rand(),
    "vector_similarity": _any(cosine),
    "soundex": _strings(F.soundex),
    "levenshtein": _strings(F.levenshtein),
}
