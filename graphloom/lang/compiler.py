"""From clauses to DataFrames: each clause maps the table of bindings to the next one, and Catalyst does the rest.

A node variable ``n`` is a set of columns ``n__id``, ``n__label`` and ``n__<property>``; only properties that
the statement mentions are brought in, and a node's frame is joined only if its label or properties matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import semantics
from graphloom.functions.scalars import FUNCTIONS
from graphloom.graph import Graph
from graphloom.lang import ast
from graphloom.lang.lexer import QueryError
from graphloom.operators import paths
from graphloom.operators.partition import by_hash
from graphloom.storage import shuffled


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Sym:
    """What a variable stands for and where its columns are."""

    kind: str  # node, edge, edges, path, value
    name: str  # prefix of the columns, or the column itself
    labels: frozenset[str] | None = None  # node: the labels it can have, None for any
    props: frozenset[str] = frozenset()


@dataclass
class State:
    df: DataFrame
    scope: dict[str, Sym] = field(default_factory=dict)
    empty: bool = False  # no clause has run: one row without columns that mean anything

    def columns(self, var: str) -> list[str]:
        s = self.scope[var]
        if s.kind == "node":
            return [f"{s.name}__id", f"{s.name}__label", *(f"{s.name}__{p}" for p in sorted(s.props))]
        if s.kind == "edge":
            return [f"{s.name}__eid", f"{s.name}__type", f"{s.name}__port", *(f"{s.name}__{p}" for p in sorted(s.props))]
        return [s.name]


@dataclass
class Edges:
    """from, to, eid, type, port and properties of edges; the labels that their ends are sure to have, None where the
    edges don't tell; and the properties of the ends that stand beside them as ``from@`` and ``to@``, None if none do."""

    df: DataFrame
    props: frozenset[str] = frozenset()
    near: frozenset[str] | None = None
    far: frozenset[str] | None = None
    near_props: frozenset[str] | None = None
    far_props: frozenset[str] | None = None

    def named(self, var: str) -> DataFrame:
        return self.df.select(*[F.col(f"`{c}`").alias(f"{var}__{c}") for c in self.df.columns])


def conjuncts(e: Any) -> list:
    if e is None:
        return []
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, Any] | None = None, statement: Any = None, shards: list[int] | None = None, shard_count: int = 4):
        self.graph = graph
        self.params = params or {}
        self.used: dict[str, set[str]] = {}
        self.fresh = count()
        self.shards, self.shard_count = shards, shard_count
        self.extra: dict[str, Column] = {}
        #: the names that a counting RETURN and the matches to come still need; None where rows must stay apart
        self.need: set[str] | None = None
        #: whether a row stands for as many as its column _times says
        self.counted = False
        if statement is not None:
            ast.properties_used(self._marked(statement), self.used)

    # whole queries

    def query(self, q: ast.Query) -> DataFrame:
        out = self.part(q)
        while q.union is not None:
            right = self.part(q.union)
            if sorted(out.columns) != sorted(right.columns):
                raise QueryError("the parts of a UNION must return the same columns")
            out = out.unionByName(right)
            if not q.union_all:
                out = out.distinct()
            q = q.union
        return out

    def part(self, q: ast.Query) -> DataFrame:
        st = self.bindings(q.clauses)
        if not isinstance(q.clauses[-1], ast.Projection) or not q.clauses[-1].final:
            raise QueryError("a query must end with RETURN")
        return st.df

    def start(self) -> State:
        return State(self.graph.spark.range(0, 1, 1, 1).select(F.lit(0).alias("_one")), empty=True)

    def bindings(self, clauses: list) -> State:
        st = self.start()
        end = self._counts_only(clauses)
        self.counted = False
        for at, c in enumerate(clauses):
            if isinstance(c, ast.Match):
                self.need = None if end is None else end.union(*(ast.free_names(x) for m in clauses[at + 1 : -1] for x in (*m.patterns, m.where)))
                st = self.optional(st, c) if c.optional else self.match(st, c)
            elif isinstance(c, ast.Unwind):
                st = self.unwind(st, c)
            elif isinstance(c, ast.Projection):
                st = self.project(st, c)
            else:
                raise QueryError(f"{type(c).__name__} can't be part of a read")
            self.need = None
        return st

    def _counts_only(self, clauses: list) -> set[str] | None:
        """What a RETURN names besides what it counts, if all before it are plain matches and all its aggregates count rows."""
        *matches, p = clauses or [None]
        if not isinstance(p, ast.Projection) or p.star or not all(isinstance(m, ast.Match) and not m.optional for m in matches):
            return None
        found: list[tuple] = []
        said = [*(i.expr for i in p.items), *(e for e, _ in p.order), *(p.group_by or [])]
        self._aggregates(said, found)
        bound = set().union(*(ast.free_names(x) for m in matches for x in m.patterns))
        if not found or not all(name == "count" and not distinct and (arg is None or (arg[0] == "var" and arg[1] in bound)) for _, name, distinct, arg in found):
            return None
        rest = lambda e: ("lit", None) if e in found else tuple(map(rest, e)) if isinstance(e, tuple) else [rest(x) for x in e] if isinstance(e, list) else e
        return ast.free_names(rest(said)) | ast.free_names(p.where)

    def merged(self, st: State, later: set[str]) -> State:
        """Where all that is to come hangs on one node, rows that differ in other nodes only become one, with their number:
        so many rows to a node that meet as many others are never paired."""
        if self.need is None or st.empty:
            return st
        keep = {v: s for v, s in st.scope.items() if v in later | self.need}
        joint = [v for v in keep if v in later]
        gone = [v for v, s in st.scope.items() if v not in keep and s.kind == "node"]
        if len(joint) != 1 or keep[joint[0]].kind != "node" or not gone:
            return st
        keys = [c for v in keep for c in st.columns(v)]
        if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in st.df.select(*map(col, keys)).schema):
            return st
        times = F.sum("_times") if self.counted else F.count(F.lit(1))
        self.counted = True
        return State(st.df.groupBy(*map(col, keys)).agg(times.alias("_times")), keep)

    def _marked(self, statement: Any) -> Any:
        """CLUSTER(n) reads a hidden property of n."""
        if isinstance(statement, tuple) and len(statement) == 3 and statement[0] == "fn" and statement[1] == "cluster":
            return ("prop", statement[2][0], "__cluster")
        if isinstance(statement, tuple):
            return tuple(self._marked(x) for x in statement)
        if isinstance(statement, list):
            return [self._marked(x) for x in statement]
        if isinstance(statement, dict):
            return {k: self._marked(v) for k, v in statement.items()}
        if hasattr(statement, "__dataclass_fields__"):
            return replace(statement, **{k: self._marked(getattr(statement, k)) for k in statement.__dataclass_fields__})
        return statement

    # patterns

    def match(self, st: State, m: ast.Match) -> State:
        pending = conjuncts(m.where)
        for k, p in enumerate(m.patterns):
            st = self.merged(st, set().union(*(ast.free_names(x) for x in (*m.patterns[k:], *pending))))
            st = self.pattern(st, p, pending, set().union(*(ast.free_names(x) for x in m.patterns[k + 1 :])))
        return self.filters(st, pending, last=True)

    def filters(self, st: State, pending: list, last: bool = False) -> State:
        """Applies the predicates whose variables are bound, as early as that."""
        for e in list(pending):
            inner = e[1] if e[0] == "not" else e
            if inner[0] == "exists":
                if last:
                    pending.remove(e)
                    st = self.exists(st, inner, e[0] == "not")
            elif last or ast.free_names(e) <= st.scope.keys():
                pending.remove(e)
                st = replace(st, df=st.df.filter(self.test(e, st)))
        return st

    def pattern(self, st: State, p: ast.Pattern, pending: list, later: set[str] = frozenset()) -> State:
        nodes, rels = [replace(n, var=n.var or f"_n{next(self.fresh)}") for n in p.nodes], [replace(r, var=r.var or f"_r{next(self.fresh)}") for r in p.rels]
        if rels and not p.var and not p.shortest and nodes[0].var not in st.scope and (nodes[-1].var in st.scope or (self._selective(nodes[-1], pending) and not self._selective(nodes[0], pending))):
            # start from the end that is bound or looked up
            flip = {"out": "in", "in": "out", "both": "both"}
            if all(r.hops is None for r in rels):
                nodes, rels = nodes[::-1], [replace(r, direction=flip[r.direction]) for r in rels[::-1]]
        early = None if p.shortest or not rels else self.edge_first(st, nodes[0], rels[0], nodes[1], pending)
        st = early or self.node(st, nodes[0], pending)
        trail = F.array(col(f"{st.scope[nodes[0].var].name}__id"))
        for k, r in enumerate(rels):
            source, target = nodes[k], nodes[k + 1]
            if k and not p.var and (rels[k - 1].direction, r.direction) == ("out", "in"):
                # both sides lead to this node
                st = self.merged(st, later.union(*(ast.free_names(x) for x in pending), *({x.var, *ast.free_names(x.props)} for x in (*nodes[k:], *rels[k:]))))
            if p.shortest:
                st, piece = self.shortest(st, source, r, target, pending, p.shortest == "all")
                trail = piece
            elif early is not None and k == 0:
                trail = F.concat(trail, F.array(col(f"{st.scope[target.var].name}__id")))
            elif r.hops is not None:
                st, piece = self.hops(st, source, r, target, pending)
                trail = F.concat(trail, F.slice(piece, 2, F.greatest(F.size(piece) - 1, F.lit(0))))
            else:
                st = self.expand(st, source, r, target, pending)
                trail = F.concat(trail, F.array(col(f"{st.scope[target.var].name}__id")))
        if p.var:
            st = State(st.df.withColumn(p.var, trail), {**st.scope, p.var: Sym("path", p.var)})
            st = self.filters(st, pending)
        return st

    def edge_first(self, st: State, source: ast.NodePattern, r: ast.RelPattern, target: ast.NodePattern, pending: list) -> State | None:
        """Where nothing of the first node but its id is needed, or what is needed stands in the edges' own rows, and its
        label follows from the edges, they are the scan: its frame isn't read at all."""
        if source.var in st.scope or target.var in st.scope or source.var == target.var or r.hops is not None or self.shards is not None:
            return None
        wanted = self.wanted(source)
        e = self.edge_frame(r, self.labels_of(source.label), self.labels_of(target.label), wanted, self.wanted(target))
        if e.near is None or len(e.near) != 1 or source.label not in (None, *e.near) or (wanted and e.near_props is None):
            return None
        df = e.named(r.var).withColumn(f"{source.var}__id", col(f"{r.var}__from")).withColumn(f"{source.var}__label", F.lit(next(iter(e.near))))
        own = e.near_props or frozenset()
        df = df.withColumnsRenamed({f"{r.var}__from@{p}": f"{source.var}__{p}" for p in own})
        out = State(df if st.empty else st.df.crossJoin(df), {**st.scope, source.var: Sym("node", source.var, e.near, own), r.var: Sym("edge", r.var, props=e.props)})
        out = self.inline(self.inline(out, r.var, r.props), source.var, source.props) if not any(ast.free_names(v) - out.scope.keys() for v in source.props.values()) else None
        if out is None:
            return None
        out = self.filters(out, pending)
        out = self.reach(out, target, col(f"{r.var}__to"), e.far, {p: f"{r.var}__to@{p}" for p in e.far_props} if e.far_props is not None else None)
        return self.filters(replace(out, df=out.df.drop(f"{r.var}__from", f"{r.var}__to")), pending)

    def wanted(self, n: ast.NodePattern) -> set[str]:
        """The properties that a node is asked for."""
        return (self.used.get(n.var, set()) | set(n.props)) - {"label"}

    def _selective(self, n: ast.NodePattern, pending: list) -> bool:
        return bool(n.props) or any(e[0] == "cmp" and e[1] == "=" and ast.free_names(e) == {n.var} for e in pending)

    def labels_of(self, label: str | None) -> frozenset[str] | None:
        return None if label is None else frozenset([label])

    def node_frame(self, var: str, labels: frozenset[str] | None, inline: dict) -> tuple[DataFrame, Sym]:
        """The nodes that can be ``var``, with the columns that it needs."""
        want = (self.used.get(var, set()) | set(inline)) - {"label"}
        if labels and len(labels) == 1 and next(iter(labels)) in self.graph.nodes:
            want |= {self.graph.nodes[next(iter(labels))].key} - {None}  # dropped again where no id is looked up
        scan = self.graph.node_scan(None if labels is None else sorted(labels), want)
        have = set(scan.columns) - {"id", "label"}
        if "__cluster" in want:
            from graphloom.operators.community import communities

            groups = communities(self.graph).select(F.col("id").alias("_c_id"), F.col("community").alias("__cluster"))
            scan = shuffled(scan).join(groups, F.col("id") == F.col("_c_id"), "left").drop("_c_id")
            have |= {"__cluster"}
        if self.shards is not None:
            scan = scan.filter(by_hash(F.col("id"), self.shard_count).isin(self.shards))
        sym = Sym("node", var, labels, frozenset(have))
        return scan.select(*[F.col(f"`{c}`").alias(f"{var}__{c}") for c in ["id", "label", *sorted(have)]]), sym

    def node(self, st: State, n: ast.NodePattern, pending: list) -> State:
        if n.var in st.scope:
            st = self.bound_node(st, n)
        else:
            scan, sym = self.node_frame(n.var, self.labels_of(n.label), n.props)
            own = State(scan, {n.var: sym})
            own = self.inline(own, n.var, n.props) if not any(ast.free_names(v) for v in n.props.values()) else own
            own = self.filters(own, pending)
            if st.empty:
                st = own
            else:
                st = State(st.df.crossJoin(own.df), {**st.scope, **own.scope})
            if any(ast.free_names(v) for v in n.props.values()):
                st = self.inline(st, n.var, n.props)
        return self.filters(st, pending)

    def bound_node(self, st: State, n: ast.NodePattern) -> State:
        s = st.scope[n.var]
        if s.kind != "node":
            raise QueryError(f"{n.var} is not a node")
        if n.label is not None and s.labels != frozenset([n.label]):
            st = replace(st, df=st.df.filter(col(f"{s.name}__label").eqNullSafe(F.lit(n.label))))
            st = replace(st, scope={**st.scope, n.var: replace(s, labels=frozenset([n.label]))})
        return self.inline(st, n.var, n.props)

    def inline(self, st: State, var: str, props: dict) -> State:
        for key, value in props.items():
            st = replace(st, df=st.df.filter(self.test(("cmp", "=", ("prop", ("var", var), key), value), st)))
        return st

    def edge_frame(self, r: ast.RelPattern, source: frozenset[str] | None, target: frozenset[str] | None, near_want: set[str] = frozenset(), far_want: set[str] = frozenset()) -> Edges:
        """The edges that fit. What is wanted of a node comes with them if they are all of one type whose rows are that
        node's own rows, so that its table need not be joined with itself."""
        want = self.used.get(r.var, set()) | set(r.props)
        fitting = []
        for kind, frame in self.graph.edges.items():
            if r.types and kind not in r.types:
                continue
            for a, b in {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[r.direction]:
                la, lb = (frame.src_label, frame.dst_label) if a == "src" else (frame.dst_label, frame.src_label)
                if not ((source and la and la not in source) or (target and lb and lb not in target)):
                    fitting.append((kind, frame, a, b, la, lb))
        if not fitting:
            none = self.graph.spark.range(0)
            return Edges(none.select(*[F.col("id").alias(c) for c in ("from", "to", "eid")], F.lit("").alias("type"), F.lit(0).alias("port")))
        parts, have = [], set()
        hosted: dict[str, frozenset[str]] = {}
        for kind, frame, a, b, la, lb in fitting:
            df, props = frame.df, [p for p in frame.props if p in want]
            if len(fitting) == 1 and frame.host is not None:
                end, row, owner = frame.host
                side, label, asked = ("from", la, near_want) if end == a else ("to", lb, far_want)
                if asked and "__cluster" not in asked and owner is self.graph.nodes.get(label) and self.shards is None:
                    df, hosted[side] = row(), frozenset(p for p in {*asked, owner.key} if p in owner.df.columns)
            if r.direction == "both" and a == "dst":
                df = df.filter("src <> dst")
            if r.port is not None:
                df = df.filter(F.col("port") == r.port)
            beside = [F.col(f"`{p}`").alias(f"{side}@{p}") for side, names in hosted.items() for p in sorted(names)]
            parts.append(df.select(F.col(a).alias("from"), F.col(b).alias("to"), "eid", F.lit(kind).alias("type"), "port", *[F.col(f"`{p}`") for p in props], *beside))
            have |= set(props)
        labels = lambda found: None if None in found else frozenset(found)
        union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        return Edges(union, frozenset(have), labels({f[4] for f in fitting}), labels({f[5] for f in fitting}), hosted.get("from"), hosted.get("to"))

    def expand(self, st: State, source: ast.NodePattern, r: ast.RelPattern, target: ast.NodePattern, pending: list) -> State:
        s = st.scope[source.var]
        bound = target.var in st.scope
        known = st.scope[target.var].labels if bound else self.labels_of(target.label)
        e = self.edge_frame(r, s.labels, known, far_want=set() if bound else self.wanted(target))
        on = col(f"{s.name}__id") == col(f"{r.var}__from")
        if bound:
            on = on & (col(f"{r.var}__to") == col(f"{st.scope[target.var].name}__id"))
        out = State(st.df.join(e.named(r.var), on), {**st.scope, r.var: Sym("edge", r.var, props=e.props)})
        out = self.inline(out, r.var, r.props)
        if bound:
            out = self.bound_node(out, target)
        else:
            out = self.reach(out, target, col(f"{r.var}__to"), e.far, {p: f"{r.var}__to@{p}" for p in e.far_props} if e.far_props is not None else None)
        out = replace(out, df=out.df.drop(f"{r.var}__from", f"{r.var}__to"))
        return self.filters(out, pending)

    def reach(self, st: State, n: ast.NodePattern, at: Column, sure: frozenset[str] | None, there: dict[str, str] | None = None) -> State:
        """Binds a node that an edge leads to; ``sure`` are the labels that the edge vouches for. The node's frame
        is joined only if something of it is needed, its label included, and not ``there`` already: its properties, and
        the columns that hold them."""
        wanted = self.used.get(n.var, set()) | set(n.props)
        one = next(iter(sure)) if sure and len(sure) == 1 and n.label in (None, *sure) else None
        labels = self.labels_of(n.label) or sure
        if there is not None and one is not None:
            df = st.df.withColumnsRenamed({c: f"{n.var}__{p}" for p, c in there.items()}).withColumn(f"{n.var}__id", at).withColumn(f"{n.var}__label", F.lit(one))
            return self.inline(State(df, {**st.scope, n.var: Sym("node", n.var, sure, frozenset(there))}), n.var, n.props)
        if not (wanted - {"label"}) and one is not None and self.shards is None:
            st = State(st.df.withColumn(f"{n.var}__id", at).withColumn(f"{n.var}__label", F.lit(one)), {**st.scope, n.var: Sym("node", n.var, sure)})
        else:
            scan, sym = self.node_frame(n.var, labels, n.props)
            st = State(st.df.join(scan, at == col(f"{n.var}__id")), {**st.scope, n.var: sym})
        return self.inline(st, n.var, n.props)

    def _ends(self, st: State, source: ast.NodePattern, target: ast.NodePattern, found: DataFrame, far, pending: list, var: str, rel: str | None) -> State:
        """Joins found (start, end, ...) to the bindings at the source, and binds or checks the target."""
        s = st.scope[source.var]
        named = found.select(*[F.col(c).alias(f"{var}__{c}") for c in found.columns])
        on = col(f"{s.name}__id") == col(f"{var}__start")
        if target.var in st.scope:
            on = on & (col(f"{var}__end") == col(f"{st.scope[target.var].name}__id"))
            out = self.bound_node(State(st.df.join(named, on), st.scope), target)
        else:
            out = self.reach(State(st.df.join(named, on), st.scope), target, col(f"{var}__end"), far)
        if rel:
            out = State(out.df.withColumnRenamed(f"{var}__eids", rel), {**out.scope, rel: Sym("edges", rel)})
        return self.filters(out, pending)

    def _starts(self, st: State, source: ast.NodePattern) -> DataFrame:
        return st.df.select(col(f"{st.scope[source.var].name}__id").alias("start")).distinct()

    def hops(self, st: State, source, r, target, pending) -> tuple[State, Column]:
        low, high = r.hops
        s = st.scope[source.var]
        e = self.edge_frame(r, None, None)
        edges, far = e.df, e.far
        found = paths.variable_length(self._starts(st, source), edges, max(low or 1, 1), high)
        if low == 0:
            zero = self._starts(st, source).select("start", F.col("start").alias("end"), F.array("start").alias("path"), F.array().cast("array<bigint>").alias("eids"))
            found = zero.unionByName(found)
            far = None if far is None or s.labels is None else far | s.labels
        var = f"_p{next(self.fresh)}"
        named = r.var if not r.var.startswith("_r") else None
        return self._ends(st, source, target, found, far, pending, var, named), col(f"{var}__path")

    def shortest(self, st: State, source, r, target, pending, every: bool) -> tuple[State, Column]:
        high = 1 if r.hops is None else r.hops[1]
        e = self.edge_frame(r, None, None)
        edges, far = e.df, e.far
        starts = self._starts(st, source)
        var = f"_p{next(self.fresh)}"
        if target.var in st.scope:
            t = st.scope[target.var]
            targets = st.df.select(col(f"{t.name}__id").alias("end")).distinct()
            found = paths.shortest(starts, edges, high, targets, every)
            both = st.df.select(col(f"{st.scope[source.var].name}__id").alias("start"), col(f"{t.name}__id").alias("end")).filter("start = end").distinct()
            found = found.filter("start <> end").unionByName(both.select("start", "end", F.array("start").alias("path")))
        else:
            targets = None
            if any(ast.free_names(e) == {target.var} for e in pending) or target.props:
                # predicates on the target alone narrow the search and end it early
                scan, sym = self.node_frame(target.var, self.labels_of(target.label) or far, target.props)
                own = self.inline(State(scan, {target.var: sym}), target.var, target.props)
                own = self.filters(own, [e for e in pending if ast.free_names(e) == {target.var}])
                targets = own.df.select(col(f"{target.var}__id").alias("end"))
            found = paths.shortest(starts, edges, high, targets, every)
        return self._ends(st, source, target, found.select("start", "end", "path"), far, pending, var, None), col(f"{var}__path")

    # optional, exists

    def _apart(self, st: State, patterns: list[ast.Pattern], where: Any) -> tuple[State, list[str]]:
        """Matches of patterns for themselves, and the variables they share with st. If the predicate (or a long
        path) needs the outer bindings, the matching starts from the distinct values of those."""
        names = set().union(*(ast.free_names(p) for p in patterns))
        shared = [v for v in st.scope if v in names]
        outer = [v for v in st.scope if v in names | ast.free_names(where)]
        long = any(r.hops is not None or p.shortest for p in patterns for r in p.rels)
        if (ast.free_names(where) <= names and not long) or not outer:
            keep = {v: st.scope[v].labels for v in shared if st.scope[v].kind == "node"}
            own = [replace(p, nodes=[replace(n, label=n.label or (next(iter(keep[n.var])) if n.var in keep and keep[n.var] and len(keep[n.var]) == 1 else None)) for n in p.nodes]) for p in patterns]
            return self._whole(self.start(), ast.Match(own, where)), shared
        keys = [c for v in outer for c in st.columns(v)]
        begin = State(st.df.select(*[col(c) for c in keys]).distinct(), {v: st.scope[v] for v in outer})
        return self._whole(begin, ast.Match(patterns, where)), outer

    def _whole(self, st: State, m: ast.Match) -> State:
        """A match beside the rows of the query, whose own rows stay as they are."""
        need, self.need = self.need, None
        try:
            return self.match(st, m)
        finally:
            self.need = need

    def _key(self, s: Sym) -> str:
        return {"node": f"{s.name}__id", "edge": f"{s.name}__eid"}.get(s.kind, s.name)

    def optional(self, st: State, m: ast.Match) -> State:
        inner, shared = self._apart(st, m.patterns, m.where)
        new = {v: s for v, s in inner.scope.items() if v not in st.scope and not v.startswith(("_n", "_r"))}
        on, keys = F.lit(True), []
        for k, v in enumerate(shared):
            keys.append(col(self._key(inner.scope[v])).alias(f"_o{k}"))
            # a variable that an earlier optional match left NULL matches nothing, unlike a plain NULL value
            same = F.col(f"_o{k}") == col(self._key(st.scope[v])) if st.scope[v].kind in ("node", "edge") else F.col(f"_o{k}").eqNullSafe(col(self._key(st.scope[v])))
            on = same if k == 0 else on & same
        side = inner.df.select(*keys, *[col(c) for v in new for c in inner.columns(v)])
        joined = st.df.join(side, on, "left").drop(*[f"_o{k}" for k in range(len(shared))])
        return State(joined, {**st.scope, **new})

    def exists(self, st: State, e: tuple, negated: bool) -> State:
        inner, shared = self._apart(st, [e[1]], e[2])
        if not shared:
            raise QueryError("EXISTS must share a variable with the query")
        side = inner.df.select(*[col(self._key(inner.scope[v])).alias(f"_e{k}") for k, v in enumerate(shared)])
        on = reduce(lambda a, b: a & b, [F.col(f"_e{k}") == col(self._key(st.scope[v])) for k, v in enumerate(shared)])
        return replace(st, df=st.df.join(side, on, "left_anti" if negated else "left_semi"))

    # rows and columns

    def unwind(self, st: State, u: ast.Unwind) -> State:
        value = self.column(u.expr, st)
        if not isinstance(self.type_of(value, st), (T.ArrayType, T.NullType)):
            value = F.when(value.isNotNull(), F.array(value))
        if isinstance(self.type_of(value, st), T.NullType):
            value = F.array().cast("array<string>")
        return State(st.df.withColumn(u.var, F.explode(value)), {**st.scope, u.var: Sym("value", u.var)})

    def project(self, st: State, p: ast.Projection) -> State:
        items = list(p.items)
        if p.star:
            items = [ast.Item(("var", v), v, True) for v in st.scope if not v.startswith("_")] + items
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise QueryError("two columns of one name")
        if p.group_by is not None or any(ast.has_aggregate(i.expr) for i in items):
            out, hidden = self.aggregate(st, items, p)
        else:
            out, hidden = self.plain(st, items, p)
        if p.distinct:
            out = replace(out, df=out.df.drop(*hidden.values()).distinct())
            hidden = {}
        if p.where is not None:
            out = self.filters(out, conjuncts(p.where), last=True)
        if p.order:
            keys = []
            for k, (e, down) in enumerate(p.order):
                key = col(hidden[k]) if k in hidden else self.column(self._sort_key(e, items), out)
                keys.append(key.desc_nulls_last() if down else key.asc_nulls_first())
            out = replace(out, df=out.df.orderBy(*keys))
        if p.skip is not None:
            out = replace(out, df=out.df.offset(self.number(p.skip)))
        if p.limit is not None:
            out = replace(out, df=out.df.limit(self.number(p.limit)))
        if hidden:
            out = replace(out, df=out.df.drop(*hidden.values()))
        if p.final:
            flat = []
            for i in items:
                s = out.scope[i.name]
                flat.append(col(self._key(s)).alias(i.name))
            out = State(out.df.select(*flat), {i.name: Sym("value", i.name) for i in items})
        return out

    def _sort_key(self, e: tuple, items: list[ast.Item]) -> tuple:
        """A key that is the text of an item, or its alias, is that item."""
        for i in items:
            if e == i.expr or e == ("var", i.name):
                return ("var", i.name)
        return e

    def number(self, e: tuple) -> int:
        if e[0] == "lit":
            n = e[1]
        elif e[0] == "param":
            n = self.param(e[1])
        else:
            raise QueryError("SKIP and LIMIT take a whole number")
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise QueryError("SKIP and LIMIT take a whole number")
        return n

    def _carry(self, st: State, e: tuple, name: str) -> tuple[list[Column], Sym]:
        """The columns by which a plain variable goes on under a name."""
        s = st.scope[e[1]]
        if s.kind in ("node", "edge"):
            return [col(c).alias(name + c[len(s.name) :]) for c in st.columns(e[1])], replace(s, name=name)
        return [col(s.name).alias(name)], replace(s, name=name)

    def plain(self, st: State, items: list[ast.Item], p: ast.Projection) -> tuple[State, dict[int, str]]:
        columns, scope = [], {}
        for i in items:
            if i.expr[0] == "var" and i.expr[1] in st.scope:
                own, scope[i.name] = self._carry(st, i.expr, i.name)
                columns += own
            else:
                columns.append(self.column(i.expr, st).alias(i.name))
                scope[i.name] = Sym("value", i.name)
        hidden = {}
        for k, (e, _) in enumerate(p.order):
            key = self._sort_key(e, items)
            if not (key[0] == "var" and key[1] in scope) and not (ast.free_names(key) <= scope.keys() and not (ast.free_names(key) & st.scope.keys())):
                if p.distinct:
                    continue
                hidden[k] = f"_s{k}"
                columns.append(self.column(e, st).alias(f"_s{k}"))
        return State(st.df.select(*columns), scope), hidden

    def aggregate(self, st: State, items: list[ast.Item], p: ast.Projection) -> tuple[State, dict[int, str]]:
        groups = [i.expr for i in items if not ast.has_aggregate(i.expr)]
        if p.group_by is not None:
            groups += [e for e in (self._sort_key_expr(e, items) for e in p.group_by) if e not in groups]
        found: list[tuple] = []
        for e in [i.expr for i in items] + [e for e, _ in p.order]:
            self._aggregates(e, found)
        keys, carried, scope, known = [], [], {}, {}
        for k, e in enumerate(groups):
            if e[0] == "var" and e[1] in st.scope and st.scope[e[1]].kind in ("node", "edge"):
                s = st.scope[e[1]]
                first, *rest = st.columns(e[1])
                keys.append(col(first))
                carried += [F.first(col(c)).alias(c) for c in rest]
                scope[e[1]] = s
            else:
                keys.append(self.column(e, st).alias(f"_g{k}"))
                known[repr(e)] = col(f"_g{k}")
        made = []
        for k, e in enumerate(found):
            made.append(self.aggregation(e, st).alias(f"_a{k}"))
            known[repr(e)] = col(f"_a{k}")
        grouped = st.df.groupBy(*keys) if keys else st.df.groupBy()
        after = State(grouped.agg(*(made + carried)) if made + carried else st.df.select(*keys).distinct(), scope)
        outer, self.extra = self.extra, {**self.extra, **known}
        columns, names = [], {}
        for i in items:
            if i.expr[0] == "var" and i.expr[1] in scope:
                own, names[i.name] = self._carry(after, i.expr, i.name)
                columns += own
            else:
                columns.append(self.column(i.expr, after).alias(i.name))
                names[i.name] = Sym("value", i.name)
        hidden = {}
        for k, (e, _) in enumerate(p.order):
            key = self._sort_key(e, items)
            if not (key[0] == "var" and key[1] in names) and not (ast.free_names(key) <= names.keys() and not ast.has_aggregate(key)):
                hidden[k] = f"_s{k}"
                columns.append(self.column(e, after).alias(f"_s{k}"))
        self.extra = outer
        return State(after.df.select(*columns), names), hidden

    def _sort_key_expr(self, e: tuple, items: list[ast.Item]) -> tuple:
        return next((i.expr for i in items if e == ("var", i.name) and i.aliased), e)

    def _aggregates(self, e: Any, found: list) -> None:
        if isinstance(e, tuple):
            if e and e[0] == "agg":
                if e not in found:
                    found.append(e)
                return
            for x in e:
                self._aggregates(x, found)
        elif isinstance(e, list):
            for x in e:
                self._aggregates(x, found)

    def aggregation(self, e: tuple, st: State) -> Column:
        _, name, distinct, arg = e
        if self.counted:
            return F.coalesce(F.sum("_times"), F.lit(0).cast("bigint"))
        if arg is None:
            return F.count(F.lit(1))
        value = self.column(arg, st)
        if name in ("sum", "avg"):
            t = semantics.kind(self.type_of(value, st))
            value = value.cast("double") if t == "number" else F.lit(None).cast("double")
            if name == "sum":
                return F.sum_distinct(value) if distinct else F.sum(value)
            return F.try_divide(F.sum_distinct(value), F.count_distinct(value)) if distinct else F.avg(value)
        if name == "count":
            return F.count_distinct(value) if distinct else F.count(value)
        if name == "collect":
            return F.sort_array(F.collect_set(value) if distinct else F.collect_list(value))
        return {"min": F.min, "max": F.max}[name](value)

    # expressions

    def param(self, name: str) -> Any:
        if name not in self.params:
            raise QueryError(f"no value for parameter ${name}")
        return self.params[name]

    def type_of(self, c: Column, st: State) -> T.DataType:
        return st.df.select(c.alias("x")).schema[0].dataType

    def literal(self, v: Any) -> Column:
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("bigint")
        if isinstance(v, (list, tuple)):
            return F.array(*[self.literal(x) for x in v])
        if isinstance(v, dict):
            return F.struct(*[self.literal(x).alias(k) for k, x in v.items()])
        return F.lit(v)

    def test(self, e: tuple, st: State) -> Column:
        c = self.column(e, st)
        return c if e[0] in ("cmp", "and", "or", "not", "isnull") else semantics.truthy(c, self.type_of(c, st))

    def column(self, e: tuple, st: State) -> Column:
        if repr(e) in self.extra:
            return self.extra[repr(e)]
        return getattr(self, f"_{e[0]}")(e, st)

    def _lit(self, e, st):
        return self.literal(e[1])

    def _param(self, e, st):
        return self.literal(self.param(e[1]))

    def _var(self, e, st):
        if e[1] not in st.scope:
            raise QueryError(f"unknown variable {e[1]}")
        return col(self._key(st.scope[e[1]]))

    def _prop(self, e, st):
        base, name = e[1], e[2]
        if base[0] == "var" and base[1] in st.scope:
            s = st.scope[base[1]]
            if s.kind in ("node", "edge"):
                if name in s.props:
                    return col(f"{s.name}__{name}")
                if name == "id":
                    return col(self._key(s))
                return F.lit(None)
        return self.column(base, st).getField(name)

    def _index(self, e, st):
        base, at = self.column(e[1], st), self.column(e[2], st)
        if isinstance(self.type_of(base, st), T.ArrayType):
            return F.get(base, at.cast("int"))
        return F.try_element_at(base, at) if isinstance(self.type_of(base, st), T.MapType) else base.getField(e[2][1])

    def _list(self, e, st):
        return F.array(*[self.column(x, st) for x in e[1]])

    def _map(self, e, st):
        return F.struct(*[self.column(v, st).alias(k) for k, v in e[1].items()])

    def _set_by(self, e: tuple) -> bool:
        return (e[0] == "lit" and e[1] is not None) or (e[0] == "param" and self.params.get(e[1]) is not None)

    def _cmp(self, e, st):
        op, left, right = e[1], e[2], e[3]
        by_key = self._by_key(op, left, right, st) if op == "=" else None
        if by_key is not None:
            return by_key
        a, b = self.column(left, st), self.column(right, st)
        return semantics.compare(op, a, b, self.type_of(a, st), self.type_of(b, st), self._set_by(left), self._set_by(right))

    def _by_key(self, op, left, right, st) -> Column | None:
        """id(n) = constant on one label becomes a test of the key column, which the scan can look up."""
        for x, y in ((left, right), (right, left)):
            if x[0] == "fn" and x[1] in ("id", "elementid") and x[2][0][0] == "var" and self._set_by(y):
                s = st.scope.get(x[2][0][1])
                if s and s.kind == "node" and s.labels and len(s.labels) == 1:
                    frame = self.graph.nodes.get(next(iter(s.labels)))
                    value = y[1] if y[0] == "lit" else self.param(y[1])
                    if frame and frame.key and frame.key in s.props and isinstance(value, int):
                        return col(f"{s.name}__{frame.key}") == F.lit(value - frame.offset)
        return None

    def _and(self, e, st):
        return self.test(e[1], st) & self.test(e[2], st)

    def _or(self, e, st):
        return self.test(e[1], st) | self.test(e[2], st)

    def _not(self, e, st):
        return ~self.test(e[1], st)

    def _isnull(self, e, st):
        c = self.column(e[1], st)
        return c.isNotNull() if e[2] else c.isNull()

    def _in(self, e, st):
        value, many = self.column(e[1], st), e[2]
        if many[0] == "param" and isinstance(self.param(many[1]), (list, tuple)):
            many = ("list", [("lit", v) for v in self.param(many[1])])
        if many[0] == "list":
            if all(x[0] == "lit" and x[1] is not None for x in many[1]) and many[1]:
                return F.coalesce(value.isin([x[1] for x in many[1]]), F.lit(False))
            return reduce(lambda a, b: a | b, [value.eqNullSafe(self.column(x, st)) for x in many[1]], F.lit(False))
        return F.coalesce(F.exists(self.column(many, st), lambda x: x.eqNullSafe(value)), F.lit(False))

    def _neg(self, e, st):
        return -self.column(e[1], st)

    def _arith(self, e, st):
        a, b = self.column(e[2], st), self.column(e[3], st)
        ta, tb = self.type_of(a, st), self.type_of(b, st)
        if e[1] == "+" and "string" in (semantics.kind(ta), semantics.kind(tb)):
            return F.concat(a.cast("string"), b.cast("string"))
        if e[1] == "+" and isinstance(ta, T.ArrayType):
            return F.concat(a, b if isinstance(tb, T.ArrayType) else F.array(b))
        whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
        if e[1] == "+":
            return F.try_add(a, b)
        if e[1] == "-":
            return F.try_subtract(a, b)
        if e[1] == "*":
            return F.try_multiply(a, b)
        if e[1] == "%":
            return F.try_mod(a, b)
        # whole numbers divide to whole numbers, toward zero
        return F.when(b != 0, F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0)))) if whole else F.try_divide(a.cast("double"), b.cast("double"))

    def _case(self, e, st):
        _, operand, whens, other = e
        out = None
        for test, value in whens:
            when = self.test(test, st) if operand is None else self._cmp(("cmp", "=", operand, test), st)
            out = F.when(when, self.column(value, st)) if out is None else out.when(when, self.column(value, st))
        return out.otherwise(self.column(other, st))

    def _exists(self, e, st):
        raise QueryError("EXISTS can only be a whole predicate of WHERE, or its negation")

    def _agg(self, e, st):
        raise QueryError("an aggregate can only be used in RETURN and WITH")

    def _fn(self, e, st):
        name, args = e[1], e[2]
        if name in ("id", "elementid"):
            s = st.scope.get(args[0][1]) if args[0][0] == "var" else None
            return col(self._key(s)) if s and s.kind in ("node", "edge") else F.lit(None).cast("bigint")
        if name == "type":
            s = st.scope.get(args[0][1]) if args[0][0] == "var" else None
            return col(f"{s.name}__type") if s and s.kind == "edge" else F.lit(None).cast("string")
        if name in ("label", "labels"):
            s = st.scope.get(args[0][1]) if args[0][0] == "var" else None
            if not s or s.kind != "node":
                raise QueryError(f"{name}() takes a node")
            c = col(f"{s.name}__label")
            return c if name == "label" else F.array(c)
        if name == "port":
            return col(f"{st.scope[args[0][1]].name}__port")
        if name == "cluster":
            return self.column(("prop", args[0], "__cluster"), st)
        if name not in FUNCTIONS:
            raise QueryError(f"unknown function {name}")
        columns = [self.column(a, st) for a in args]
        return FUNCTIONS[name](columns, [self.type_of(c, st) for c in columns])
