"""Writes. A graph never changes: each statement gives the next graph, whose frames are plans over the last one's."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import EdgeFrame, Graph, NodeFrame
from graphloom.lang import ast
from graphloom.lang.compiler import Compiler, State, Sym, col
from graphloom.lang.lexer import QueryError
from graphloom.storage import materialise


#: The property whose vectors are searched.
VECTOR = "embedding"


def settled(graph: Graph, before: Graph) -> Graph:
    """The graph with the frames that differ from an earlier version's written to the shared folder."""
    for label, frame in graph.nodes.items():
        if frame is not before.nodes.get(label):
            graph = graph.with_nodes(label, NodeFrame(materialise(frame.df, "nodes"), frame.key, frame.offset))
    for kind, edge in graph.edges.items():
        if edge is not before.edges.get(kind):
            graph = graph.with_edges(kind, EdgeFrame(materialise(edge.df, "edges"), edge.src_label, edge.dst_label))
    return graph


def _next_id(graph: Graph, label: str) -> DataFrame:
    """One row with the first free id: of the label's own range if it has one, else of the graph."""
    frame = graph.nodes.get(label)
    own = frame.df.select("id") if frame and frame.key else graph.all_nodes().select("id")
    floor = frame.offset if frame and frame.key else 0
    return own.agg(F.coalesce(F.max("id") + 1, F.lit(floor)).cast("bigint").alias("_base"))


def _numbered(df: DataFrame) -> DataFrame:
    """A number for each row: unique, from 0 on in the first partition, with gaps between partitions."""
    return df.withColumn("_nth", F.monotonically_increasing_id())


def _key_props(frame: NodeFrame | None) -> dict[str, Column]:
    """A keyed frame's key follows from the new id."""
    return {frame.key: col("id") - F.lit(frame.offset)} if frame and frame.key else {}


def add_nodes(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """rows has id and properties; missing ones become NULL, new ones are added."""
    frame = graph.nodes.get(label)
    for key, value in _key_props(frame).items():
        rows = rows.withColumn(key, value)
    return graph.with_nodes(label, NodeFrame(rows) if frame is None else NodeFrame(frame.df.unionByName(rows, allowMissingColumns=True), frame.key, frame.offset))


def add_edges(graph: Graph, kind: str, rows: DataFrame, ends: tuple[str | None, str | None]) -> Graph:
    """rows has src, dst, port and properties; edge ids go on from the largest of the graph."""
    base = graph.all_edges().agg(F.coalesce(F.max("eid") + 1, F.lit(0)).cast("bigint").alias("_base"))
    fresh = _numbered(rows).crossJoin(base).withColumn("eid", F.col("_base") + F.col("_nth")).drop("_base", "_nth")
    frame = graph.edges.get(kind)
    if frame is None:
        return graph.with_edges(kind, EdgeFrame(fresh.select("eid", "src", "dst", "port", *[c for c in fresh.columns if c not in ("eid", "src", "dst", "port")]), *ends))
    widened = lambda old, new: old if old == new else None
    return graph.with_edges(kind, EdgeFrame(frame.df.unionByName(fresh, allowMissingColumns=True), widened(frame.src_label, ends[0]), widened(frame.dst_label, ends[1])))


def _one_label(s: Sym) -> str | None:
    return next(iter(s.labels)) if s.labels and len(s.labels) == 1 else None


class Writer:
    """Runs the clauses of a writing statement one after the other over the bindings."""

    def __init__(self, graph: Graph, params: dict[str, Any] | None, query: ast.Query, dimension: int | None = None):
        self.graph, self.params, self.query, self.dimension = graph, params, query, dimension

    def fits(self, rows: DataFrame, column: str) -> None:
        """Vectors that are written must have the dimension that was set, if one was."""
        if self.dimension is not None and isinstance(rows.schema[column].dataType, T.ArrayType) and not rows.filter(F.size(col(column)) != self.dimension).isEmpty():
            raise QueryError(f"a vector has {self.dimension} parts here")

    def compiler(self) -> Compiler:
        return Compiler(self.graph, self.params, self.query)

    def run(self) -> tuple[Graph, DataFrame | None]:
        """The new graph, and what a closing RETURN gives."""
        st = self.compiler().start()
        for c in self.query.clauses:
            comp = self.compiler()
            if isinstance(c, ast.Match):
                st = comp.optional(st, c) if c.optional else comp.match(st, c)
            elif isinstance(c, ast.Unwind):
                st = comp.unwind(st, c)
            elif isinstance(c, ast.Projection):
                st = comp.project(st, c)
                if c.final:
                    return self.graph, st.df
            elif isinstance(c, ast.Create):
                st = self.create(st, c.patterns)
            elif isinstance(c, ast.Merge):
                st = self.merge(st, c)
            elif isinstance(c, ast.SetProps):
                self.set(st, c.items)
            elif isinstance(c, ast.Remove):
                self.set(st, [(v, p, ("lit", None)) for v, p in c.items])
            elif isinstance(c, ast.Delete):
                self.delete(st, c)
        return self.graph, None

    # creation

    def create(self, st: State, patterns: list[ast.Pattern]) -> State:
        for p in patterns:
            for n in p.nodes:
                if n.var is None or n.var not in st.scope:
                    n.var = n.var or f"_c{id(n)}"
                    st = self.new_node(st, n)
            for k, r in enumerate(p.rels):
                if len(r.types) != 1 or r.hops is not None or r.direction == "both":
                    raise QueryError("a created relationship has one type and one direction")
                a, b = (p.nodes[k].var, p.nodes[k + 1].var)
                self.new_edge(st, r, *((b, a) if r.direction == "in" else (a, b)))
        return st

    def new_node(self, st: State, n: ast.NodePattern) -> State:
        label = n.label or ""
        comp = self.compiler()
        props = {k: comp.column(v, st) for k, v in n.props.items()}
        own = _numbered(st.df.select("*", *[v.alias(f"{n.var}__{k}") for k, v in props.items()]))
        own = own.crossJoin(_next_id(self.graph, label)).withColumn(f"{n.var}__id", F.col("_base") + F.col("_nth")).drop("_base", "_nth").withColumn(f"{n.var}__label", F.lit(label))
        # written, as the bindings and the graph must see the same ids
        kept = materialise(own, "created")
        if VECTOR in props:
            self.fits(kept, f"{n.var}__{VECTOR}")
        rows = kept.select(col(f"{n.var}__id").alias("id"), *[col(f"{n.var}__{k}").alias(k) for k in props])
        self.graph = add_nodes(self.graph, label, rows)
        return State(kept, {**st.scope, n.var: Sym("node", n.var, frozenset([label]), frozenset(props))})

    def new_edge(self, st: State, r: ast.RelPattern, a: str, b: str) -> None:
        comp = self.compiler()
        rows = st.df.select(col(f"{a}__id").alias("src"), col(f"{b}__id").alias("dst"), F.lit(r.port or 0).cast("int").alias("port"), *[comp.column(v, st).alias(k) for k, v in r.props.items()])
        kept = materialise(rows.filter("src IS NOT NULL AND dst IS NOT NULL"), "created")
        self.graph = add_edges(self.graph, r.types[0], kept, (_one_label(st.scope[a]), _one_label(st.scope[b])))

    # merge: what is there is bound, what is missing is created once

    def merge(self, st: State, m: ast.Merge) -> State:
        for n in m.pattern.nodes:
            if n.var is None or n.var not in st.scope:
                n.var = n.var or f"_m{id(n)}"
                st = self.merge_node(st, n, m)
        for k, r in enumerate(m.pattern.rels):
            a, b = m.pattern.nodes[k].var, m.pattern.nodes[k + 1].var
            self.merge_edge(st, r, *((b, a) if r.direction == "in" else (a, b)))
        return st

    def merge_node(self, st: State, n: ast.NodePattern, m: ast.Merge) -> State:
        label = n.label or ""
        comp = self.compiler()
        keys = list(n.props)
        own = st.df.select("*", *[comp.column(v, st).alias(f"_k_{k}") for k, v in n.props.items()])
        frame = self.graph.nodes.get(label)
        if frame is not None and all(k in frame.df.columns for k in keys):
            first = frame.df.groupBy(*[col(k) for k in keys]).agg(F.min("id").alias("_found")) if keys else frame.df.agg(F.min("id").alias("_found"))
            there = first.select("_found", *[col(k).alias(f"_h_{k}") for k in keys])
            on = F.lit(True)
            for k in keys:
                on = on & col(f"_k_{k}").eqNullSafe(col(f"_h_{k}"))
            own = own.join(there, on, "left").drop(*[f"_h_{k}" for k in keys])
        else:
            own = own.withColumn("_found", F.lit(None).cast("bigint"))
        own = materialise(own, "merged")
        missing = own.filter("_found IS NULL").select(*[col(f"_k_{k}").alias(k) for k in keys]).distinct() if keys else own.filter("_found IS NULL").select(F.lit(1).alias("_one")).distinct()
        made = _numbered(missing).crossJoin(_next_id(self.graph, label)).withColumn("id", F.col("_base") + F.col("_nth")).drop("_base", "_nth", "_one")
        made = materialise(made, "merged-new")
        matched = own.filter("_found IS NOT NULL").select(F.col("_found").alias("_merged")).distinct()
        self.graph = add_nodes(self.graph, label, made)
        plain = ast.NodePattern(n.var, label, {})
        on_create = [x for x in m.on_create if x[0] == n.var]
        on_match = [x for x in m.on_match if x[0] == n.var]
        for items, ids in ((on_create, made.select(F.col("id").alias("_merged"))), (on_match, matched)):
            if items:
                self.set(self.compiler().reach(State(ids, {}), plain, col("_merged"), frozenset([label])), items)
        new = made.select(F.col("id").alias("_new"), *[col(k).alias(f"_h_{k}") for k in keys])
        on = F.col("_found").isNull()
        for k in keys:
            on = on & col(f"_k_{k}").eqNullSafe(col(f"_h_{k}"))
        bound = own.join(new, on, "left").withColumn("_merged", F.coalesce("_found", "_new"))
        bound = bound.drop("_found", "_new", *[f"_k_{k}" for k in keys], *[f"_h_{k}" for k in keys])
        out = self.compiler().reach(State(bound, st.scope), plain, col("_merged"), frozenset([label]))
        return State(out.df.drop("_merged"), out.scope)

    def merge_edge(self, st: State, r: ast.RelPattern, a: str, b: str) -> None:
        if len(r.types) != 1:
            raise QueryError("a merged relationship has one type")
        pairs = st.df.select(col(f"{a}__id").alias("src"), col(f"{b}__id").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
        frame = self.graph.edges.get(r.types[0])
        if frame is not None:
            pairs = pairs.join(frame.df.select("src", "dst"), ["src", "dst"], "left_anti")
        rows = materialise(pairs.withColumn("port", F.lit(r.port or 0)), "merged-edges")
        self.graph = add_edges(self.graph, r.types[0], rows, (_one_label(st.scope[a]), _one_label(st.scope[b])))

    # change and removal

    def set(self, st: State, items: list[tuple[str, str, ast.Expr]]) -> None:
        comp = self.compiler()
        by: dict[str, list] = {}
        for var, prop, value in items:
            by.setdefault(var, []).append((prop, value))
        for var, changes in by.items():
            s = st.scope.get(var)
            if s is None or s.kind not in ("node", "edge"):
                raise QueryError(f"{var} is neither a node nor a relationship")
            key = "id" if s.kind == "node" else "eid"
            # a row expression that differs between matches of one node: the largest value counts
            new = st.df.select(col(f"{s.name}__{key}").alias("_id"), *[comp.column(v, st).alias(f"_v_{p}") for p, v in changes]).filter("_id IS NOT NULL").groupBy("_id").agg(*[F.max(col(f"_v_{p}")).alias(f"_v_{p}") for p, _ in changes])
            new = materialise(new, "set")
            if s.kind == "node" and VECTOR in dict(changes):
                self.fits(new, f"_v_{VECTOR}")
            frames = self.graph.nodes if s.kind == "node" else self.graph.edges
            names = [x for x in frames if s.labels is None or s.kind == "edge" or x in s.labels]
            for name in names:
                frame = frames[name]
                joined = frame.df.join(new, frame.df[key] == new["_id"], "left")
                columns = [col(c) if c not in dict(changes) else F.when(F.col("_id").isNotNull(), col(f"_v_{c}")).otherwise(col(c)).alias(c) for c in frame.df.columns]
                columns += [col(f"_v_{p}").alias(p) for p, _ in changes if p not in frame.df.columns]
                df = joined.select(*columns)
                self.graph = self.graph.with_nodes(name, NodeFrame(df, frame.key, frame.offset)) if s.kind == "node" else self.graph.with_edges(name, EdgeFrame(df, frame.src_label, frame.dst_label))

    def delete(self, st: State, d: ast.Delete) -> None:
        for var in d.names:
            s = st.scope.get(var)
            if s is None or s.kind not in ("node", "edge"):
                raise QueryError(f"{var} is neither a node nor a relationship")
            if s.kind == "edge":
                gone = materialise(st.df.select(col(f"{s.name}__eid").alias("_e"), col(f"{s.name}__type").alias("_t")).distinct(), "deleted")
                for kind, frame in self.graph.edges.items():
                    df = frame.df.join(gone.filter(F.col("_t") == kind), F.col("eid") == F.col("_e"), "left_anti")
                    self.graph = self.graph.with_edges(kind, EdgeFrame(df, frame.src_label, frame.dst_label))
                continue
            gone = materialise(st.df.select(col(f"{s.name}__id").alias("_d")).filter("_d IS NOT NULL").distinct(), "deleted")
            if not d.detach and any(not self.graph.all_edges().join(gone, F.col(end) == F.col("_d"), "left_semi").isEmpty() for end in ("src", "dst")):
                raise QueryError("a node with relationships is deleted by DETACH DELETE")
            for label, frame in self.graph.nodes.items():
                if s.labels is None or label in s.labels:
                    self.graph = self.graph.with_nodes(label, NodeFrame(frame.df.join(gone, F.col("id") == F.col("_d"), "left_anti"), frame.key, frame.offset))
            for kind, frame in self.graph.edges.items():
                df = frame.df.join(gone, F.col("src") == F.col("_d"), "left_anti").join(gone, F.col("dst") == F.col("_d"), "left_anti")
                self.graph = self.graph.with_edges(kind, EdgeFrame(df, frame.src_label, frame.dst_label))


def writes(query: Any) -> bool:
    return isinstance(query, ast.Query) and any(isinstance(c, (ast.Create, ast.Merge, ast.SetProps, ast.Remove, ast.Delete)) for c in query.clauses)
