"""A session: statements in, DataFrames out, and the versions of the graph that its writes make."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.lang import ast
from graphloom.lang.compiler import Compiler
from graphloom.lang.lexer import QueryError
from graphloom.lang.parser import parse
from graphloom.operators import fulltext, vector, versions
from graphloom.operators.mutate import Writer, add_edges, add_nodes, settled, writes
from graphloom.storage import materialise

#: After so many versions changed frames are written, so that plans do not grow with the number of statements.
SETTLE = 8


@dataclass
class Index:
    label: str
    props: list[str]
    language: str | None
    phonetic: str | None
    stored: fulltext.TextIndex


@dataclass
class Session:
    graph: Graph
    shard_count: int = 4
    clock: Any = datetime.now
    tx: int = 0
    #: (transaction, time, graph), oldest first
    versions: list[tuple[int, datetime, Graph]] = field(default_factory=list)
    pending: list[tuple[ast.Query, dict]] | None = None
    indexes: dict[str, Index] = field(default_factory=dict)
    dimension: int | None = None
    #: name: (label, property) whose values must be unique
    constraints: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: a folder to which every version's changes are appended, readable by ``operators.versions`` and ``streaming.log``
    log: str | None = None
    #: the last version whose changed frames were written
    written: Graph | None = None

    def run(self, text: str, **params: Any) -> DataFrame | None:
        """What the statement returns; writes give what their RETURN says, or None."""
        return self.statement(parse(text), params, text)

    def statement(self, s: Any, params: dict, text: str = "") -> DataFrame | None:
        if isinstance(s, ast.Explain):
            return self.explain(s, params)
        if isinstance(s, ast.Command):
            return self.command(s, params)
        if isinstance(s, ast.Call):
            return self.call(s, params)
        if writes(s):
            if self.pending is not None:
                self.pending.append((s, params))
                return None
            return self.commit([(s, params)])
        graph = self.graph if s.at_time is None else self.at(self.value(s.at_time, params))[2]
        return Compiler(graph, params, s, s.shards, self.shard_count).query(s)

    def value(self, e: tuple, params: dict) -> Any:
        """A constant expression."""
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return Compiler(self.graph, params).param(e[1])
        if e[0] == "list":
            return [self.value(x, params) for x in e[1]]
        if e[0] == "fn" and e[1] in ("datetime", "date", "timestamp") and e[2]:
            return self.value(e[2][0], params)
        raise QueryError("a constant is needed here")

    # versions and transactions

    def at(self, moment: Any) -> tuple[int, datetime, Graph]:
        """The last version committed at or before the moment."""
        when = moment if isinstance(moment, datetime) else datetime.fromisoformat(str(moment).replace("Z", ""))
        found = [v for v in self.versions if v[1] <= when]
        if not found:
            raise QueryError(f"no version at or before {when}")
        return found[-1]

    def commit(self, statements: list[tuple[ast.Query, dict]]) -> DataFrame | None:
        graph, out = self.graph, None
        for q, params in statements:
            graph, out = Writer(graph, params, q, self.dimension).run()
        self._keep(graph)
        return out

    def record(self, when: datetime) -> None:
        """Registers the present graph as a version of the given time."""
        self.tx += 1
        self.versions.append((self.tx, when, self.graph))

    def command(self, c: ast.Command, params: dict) -> DataFrame | None:
        if c.word == "begin":
            if self.pending is not None:
                raise QueryError("a transaction is open already")
            self.pending = []
        elif c.word == "flashback":
            tx, _, graph = self.at(self.value(c.arg, params))
            self.graph = graph
            return graph.spark.createDataFrame([(tx,)], "tx_id bigint")
        else:
            if self.pending is None:
                raise QueryError("no transaction is open")
            held, self.pending = self.pending, None
            if c.word == "commit" and held:
                return self.commit(held)
        return None

    def explain(self, s: ast.Explain, params: dict) -> DataFrame:
        began = time.perf_counter()
        df = self.statement(s.statement, params)
        if df is None:
            raise QueryError("only reads can be explained")
        if not s.profile:
            lines = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n")
            return df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(lines)], "line int, plan string")
        rows = df.count()
        return df.sparkSession.createDataFrame([(rows, time.perf_counter() - began)], "rows bigint, execution_time double")

    # procedures

    def call(self, c: ast.Call, params: dict) -> DataFrame:
        """Procedures are known by their name after the namespace: ``CALL any.search(...)``."""
        name = c.name.split(".", 1)[-1].lower()
        args = [self.value(a, params) for a in c.args]
        if name not in PROCEDURES:
            raise QueryError(f"unknown procedure {c.name}")
        out = PROCEDURES[name](self, *args)
        return out.select(*[F.col(a).alias(b) for a, b in c.yields]) if c.yields else out

    def vectors(self, prop: str = "embedding") -> DataFrame:
        """(id, v) of the nodes that have a vector."""
        return self.graph.node_scan(None, {prop}).select("id", F.col(prop).alias("v")).filter("v IS NOT NULL")

    def _texts(self, label: str, props: list[str]) -> DataFrame:
        scan = self.graph.node_scan([label], set(props))
        return scan.select("id", F.concat_ws(" ", *[F.col(f"`{p}`") for p in props]).alias("text"))

    def index(self, name: str) -> Index:
        if name not in self.indexes:
            raise QueryError(f"no index {name}")
        return self.indexes[name]

    # whole tables in, and out

    def load(self, nodes: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None) -> None:
        """One new version with whole tables added: nodes (id, properties) by label, edges (src, dst, properties) by
        type, which may also have a port and are numbered on from the largest edge id."""
        graph = self.graph
        for label, df in (nodes or {}).items():
            graph = add_nodes(graph, label, df)
        for kind, df in (edges or {}).items():
            rows = df if "port" in df.columns else df.withColumn("port", F.lit(0))
            graph = add_edges(graph, kind, materialise(rows, "loaded-edges"), (None, None))
        self._keep(graph)

    def _keep(self, graph: Graph) -> None:
        """Makes a graph the present version, if it keeps the constraints; logs what has changed, if there is a log."""
        changed = {n: c for n, c in self.constraints.items() if graph.nodes.get(c[0]) is not self.graph.nodes.get(c[0])}
        check_unique(graph, changed)
        when = self.clock()
        if self.log is not None:
            versions.append(self.log, versions.changes(self.graph, graph, self.tx + 1, when))
        self.written = self.written or self.graph
        if len(self.versions) % SETTLE == SETTLE - 1:
            graph = self.written = settled(graph, self.written)
        self.tx += 1
        self.graph = graph
        self.versions.append((self.tx, when, graph))


def _search(s: Session, v: list[float], metric: str, k: int) -> DataFrame:
    if s.dimension is not None and len(v) != s.dimension:
        raise QueryError(f"the vectors have {s.dimension} parts")
    return vector.knn(s.vectors(), v, k, metric).withColumnRenamed("id", "node")


def _vector_init(s: Session, dimension: int) -> DataFrame:
    if s.dimension not in (None, dimension):
        raise QueryError(f"the vectors already have {s.dimension} parts")
    s.dimension = dimension
    return s.graph.spark.createDataFrame([(dimension,)], "dimension bigint")


def _create_index(s: Session, name: str, label: str, props: list[str] | str, language: str | None = None, phonetic: bool | str | None = None) -> DataFrame:
    """Writes the index; ``phonetic`` is a sound code, or true for soundex."""
    if name in s.indexes:
        raise QueryError(f"index {name} exists")
    props, sound = [props] if isinstance(props, str) else list(props), "soundex" if phonetic is True else (phonetic or None)
    stored = fulltext.build_index(s._texts(label, props), language, sound)
    s.indexes[name] = Index(label, props, language, sound, stored)
    return _indexes(s)


def _drop_index(s: Session, name: str) -> DataFrame:
    s.index(name)
    del s.indexes[name]
    return _indexes(s)


def _rebuild_index(s: Session, name: str) -> DataFrame:
    """The index over the present graph; writes since it was made become visible to searches."""
    i = s.index(name)
    s.indexes[name] = replace(i, stored=fulltext.build_index(s._texts(i.label, i.props), i.language, i.phonetic))
    return _indexes(s)


def _delete_document(s: Session, name: str, node: int) -> DataFrame:
    i = s.index(name)
    s.indexes[name] = replace(i, stored=i.stored.delete(s.graph.spark.range(node, node + 1)))
    return _indexes(s)


def _indexes(s: Session) -> DataFrame:
    rows = [(n, i.label, ",".join(i.props), i.language, i.phonetic is not None) for n, i in sorted(s.indexes.items())]
    return s.graph.spark.createDataFrame(rows, "name string, label string, properties string, language string, phonetic boolean")


def _ft_query(s: Session, name: str, query: str, k: int = 10) -> DataFrame:
    return fulltext.index_search(s.index(name).stored, query, k).withColumnRenamed("id", "node")


def _ft_fuzzy(s: Session, name: str, query: str, k: int = 10, distance: int = 1) -> DataFrame:
    return fulltext.index_fuzzy(s.index(name).stored, query, k, distance).withColumnRenamed("id", "node")


def _violations(s: Session, label: str, prop: str) -> DataFrame:
    return s.graph.unique_violations(label, prop)


def _create_constraint(s: Session, name: str, label: str, prop: str) -> DataFrame:
    """From now on no two nodes of the label may have one value of the property, NULL included."""
    if name in s.constraints:
        raise QueryError(f"constraint {name} exists")
    check_unique(s.graph, {name: (label, prop)})
    s.constraints[name] = (label, prop)
    return _constraints(s)


def _drop_constraint(s: Session, name: str) -> DataFrame:
    if s.constraints.pop(name, None) is None:
        raise QueryError(f"no constraint {name}")
    return _constraints(s)


def _constraints(s: Session) -> DataFrame:
    return s.graph.spark.createDataFrame([(n, label, prop) for n, (label, prop) in sorted(s.constraints.items())], "name string, label string, property string")


def check_unique(graph: Graph, constraints: dict[str, tuple[str, str]]) -> None:
    for name, (label, prop) in constraints.items():
        frame = graph.nodes.get(label)
        if frame is not None and prop in frame.props and not graph.unique_violations(label, prop).isEmpty():
            raise QueryError(f"constraint {name}: {label}.{prop} is not unique")


PROCEDURES = {
    "search": _search,
    "vectorinit": _vector_init,
    "fulltext.createindex": _create_index,
    "fulltext.query": _ft_query,
    "fulltext.fuzzyquery": _ft_fuzzy,
    "fulltext.dropindex": _drop_index,
    "fulltext.indexes": _indexes,
    "fulltext.rebuild": _rebuild_index,
    "fulltext.deletedocument": _delete_document,
    "constraint.create": _create_constraint,
    "constraint.drop": _drop_constraint,
    "constraint.list": _constraints,
    "constraint.validate": _violations,
}
