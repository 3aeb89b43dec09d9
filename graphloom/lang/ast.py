"""The shapes of a parsed statement. Expressions are tuples whose first item names their kind."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Expr = tuple


@dataclass
class NodePattern:
    var: str | None
    label: str | None
    props: dict[str, Expr]


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    port: int | None
    props: dict[str, Expr]
    direction: str  # out, in, both
    hops: tuple[int | None, int | None] | None = None  # None: exactly one edge


@dataclass
class Pattern:
    var: str | None
    nodes: list[NodePattern]
    rels: list[RelPattern]
    #: False, True for one shortest path, "all" for all of them
    shortest: bool | str = False


@dataclass
class Item:
    expr: Expr
    name: str
    aliased: bool


@dataclass
class Match:
    patterns: list[Pattern]
    where: Expr | None
    optional: bool = False


@dataclass
class Unwind:
    expr: Expr
    var: str


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    group_by: list[Expr] | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    final: bool = False


@dataclass
class Create:
    patterns: list[Pattern]


@dataclass
class Merge:
    pattern: Pattern
    on_create: list[tuple[str, str, Expr]]
    on_match: list[tuple[str, str, Expr]]


@dataclass
class SetProps:
    items: list[tuple[str, str, Expr]]


@dataclass
class Remove:
    items: list[tuple[str, str]]


@dataclass
class Delete:
    names: list[str]
    detach: bool


@dataclass
class Query:
    clauses: list[Any]
    at_time: Expr | None = None
    shards: list[int] | None = None
    union: Query | None = None
    union_all: bool = False


@dataclass
class Call:
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]]


@dataclass
class Command:
    word: str  # begin, commit, rollback, flashback
    arg: Expr | None = None


@dataclass
class Explain:
    statement: Any
    profile: bool


def free_names(e: Any) -> set[str]:
    """Variables that an expression (or a pattern in it) refers to."""
    if isinstance(e, Pattern):
        found = {n.var for n in e.nodes if n.var} | {r.var for r in e.rels if r.var}
        for part in [*e.nodes, *e.rels]:
            for value in part.props.values():
                found |= free_names(value)
        return found
    if isinstance(e, tuple):
        if e and e[0] == "var":
            return {e[1]}
        if e and e[0] in ("lit", "param"):
            return set()
        return set().union(*(free_names(x) for x in e)) if e else set()
    if isinstance(e, (list, dict)):
        return set().union(set(), *(free_names(x) for x in (e.values() if isinstance(e, dict) else e)))
    return set()


def has_aggregate(e: Any) -> bool:
    if isinstance(e, tuple):
        return bool(e) and (e[0] == "agg" or any(has_aggregate(x) for x in e))
    if isinstance(e, list):
        return any(has_aggregate(x) for x in e)
    return False


def properties_used(e: Any, found: dict[str, set[str]]) -> None:
    """Adds to ``found`` the properties of each variable that occur anywhere in a statement."""
    if isinstance(e, tuple):
        if len(e) == 3 and e[0] == "prop" and e[1][0] == "var":
            found.setdefault(e[1][1], set()).add(e[2])
        for x in e:
            properties_used(x, found)
    elif isinstance(e, (list, set)):
        for x in e:
            properties_used(x, found)
    elif isinstance(e, dict):
        for x in e.values():
            properties_used(x, found)
    elif hasattr(e, "__dataclass_fields__"):
        for name in e.__dataclass_fields__:
            properties_used(getattr(e, name), found)
