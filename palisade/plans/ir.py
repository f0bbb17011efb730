"""Plan nodes and expressions as frozen dataclasses, for the front ends that need a tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any


class Node:
    """A relational operator."""


class Expr:
    """A scalar expression."""


@dataclass(frozen=True)
class EntityScan(Node):
    entity: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableScan(Node):
    table: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class WorkspaceRef(Node):
    name: str


@dataclass(frozen=True)
class Values(Node):
    """columns are (name, type); cells are Python values."""

    columns: tuple[tuple[str, str], ...]
    rows: tuple[tuple[Any, ...], ...] = ()


@dataclass(frozen=True)
class Project(Node):
    input: Node
    items: tuple[tuple[Expr, str], ...]


@dataclass(frozen=True)
class Filter(Node):
    input: Node
    condition: Expr


@dataclass(frozen=True)
class Join(Node):
    """how: inner, left, right, full, semi, anti; no condition makes a cross join."""

    left: Node
    right: Node
    how: str = "inner"
    condition: Expr | None = None


@dataclass(frozen=True)
class Union(Node):
    inputs: tuple[Node, ...]


@dataclass(frozen=True)
class Aggregate(Node):
    """calls are (function, argument or None, distinct, alias)."""

    input: Node
    keys: tuple["Ref", ...]
    calls: tuple[tuple[str, "Ref | None", bool, str], ...]


@dataclass(frozen=True)
class Sort(Node):
    """keys are (expression, descending, nulls first)."""

    input: Node
    keys: tuple[tuple[Expr, bool, bool], ...]


@dataclass(frozen=True)
class Limit(Node):
    input: Node
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Subquery(Node):
    plan: Node
    alias: str


@dataclass(frozen=True)
class Store(Node):
    """The root of a plan that writes; mode: create, replace, append."""

    target: str
    input: Node
    mode: str = "append"


@dataclass(frozen=True)
class Ref(Expr):
    name: str
    source: str | None = None


@dataclass(frozen=True)
class Lit(Expr):
    value: Any
    type: str | None = None


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Call(Expr):
    op: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Cast(Expr):
    value: Expr
    type: str


@dataclass(frozen=True)
class Over(Expr):
    """op over partition and order; without frame, the SQL default of range up to the current row."""

    op: str
    args: tuple[Expr, ...]
    partition: tuple[Expr, ...] = ()
    order: tuple[tuple[Expr, bool, bool], ...] = ()
    rows: tuple[int | None, int | None] | None = None


@dataclass(frozen=True)
class Sub(Expr):
    """kind: scalar, exists, in; operands are what IN looks for."""

    kind: str
    plan: Node
    operands: tuple[Expr, ...] = ()


def parts(item: Any) -> Iterator[Any]:
    """Nodes and expressions directly inside one."""
    if isinstance(item, (Node, Expr)):
        for f in fields(item):
            yield from parts_of(getattr(item, f.name))


def parts_of(value: Any) -> Iterator[Any]:
    if isinstance(value, (Node, Expr)):
        yield value
    elif isinstance(value, tuple):
        for x in value:
            yield from parts_of(x)


def walk(item: Any) -> Iterator[Any]:
    """The item and everything below it, subquery plans in expressions included."""
    yield item
    for x in parts(item):
        yield from walk(x)


def rebuild(item: Any, change) -> Any:
    """A copy with change applied to every node and expression from below."""

    def again(value: Any) -> Any:
        if isinstance(value, (Node, Expr)):
            return rebuild(value, change)
        if isinstance(value, tuple):
            return tuple(again(x) for x in value)
        return value

    return change(type(item)(**{f.name: again(getattr(item, f.name)) for f in fields(item)}))


def scan_set(plan: Node) -> list[str]:
    """Names that are read or stored to, each once, in order."""
    out: dict[str, None] = {}
    for x in walk(plan):
        name = x.table if isinstance(x, TableScan) else x.entity if isinstance(x, EntityScan) else x.target if isinstance(x, Store) else None
        if name is not None:
            out[name] = None
    return list(out)


def column_names(plan: Node) -> set[str]:
    return {x.name for x in walk(plan) if isinstance(x, Ref)}
