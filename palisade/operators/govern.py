"""Row policies, denied and masked columns, caps and checks.

Security lives in views: what a caller reads is the table after its row filter,
with denied columns left out and masked ones replaced. Every way to a table goes
through its view, subqueries included, so no rewrite of the caller's plan can
miss a scan. A policy whose attribute the caller lacks closes the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Table
from ..errors import EngineError
from ..functions import scalar
from ..plans import ir

TOP_N = 30
ROW_LIMIT, MOST_ROWS = 500, 100_000


@dataclass(frozen=True)
class User:
    """`tenant:user`; the parts of the name win over further attributes."""

    name: str
    roles: tuple[str, ...] = ()
    attributes: dict[str, Any] = field(default_factory=dict)

    def attribute(self, key: str) -> Any:
        tenant, _, user = self.name.rpartition(":")
        known = {**self.attributes, "user_id": user, **({"tenant_id": tenant} if tenant else {})}
        if key not in known or known[key] is None:
            raise EngineError("policy_attribute_missing", key)
        return known[key]

    @property
    def admin(self) -> bool:
        return "admin" in self.roles


@dataclass(frozen=True)
class Attribute:
    """A value taken from the user."""

    name: str


@dataclass(frozen=True)
class Eq:
    column: str
    value: Any

    def build(self, user: User) -> Column:
        return F.col(f"`{self.column}`") == F.lit(_value(self.value, user))


@dataclass(frozen=True)
class In:
    """An empty list lets no row through."""

    column: str
    values: Any

    def build(self, user: User) -> Column:
        values = _value(self.values, user)
        return F.col(f"`{self.column}`").isin(*values) if values else F.lit(False)


@dataclass(frozen=True)
class And:
    items: tuple

    def build(self, user: User) -> Column:
        return reduce(lambda a, b: a & b, [x.build(user) for x in self.items], F.lit(True))


@dataclass(frozen=True)
class Or:
    items: tuple

    def build(self, user: User) -> Column:
        return reduce(lambda a, b: a | b, [x.build(user) for x in self.items], F.lit(False))


@dataclass(frozen=True)
class Not:
    item: Any

    def build(self, user: User) -> Column:
        return ~self.item.build(user)


def _value(value: Any, user: User) -> Any:
    if isinstance(value, Attribute):
        return user.attribute(value.name)
    if isinstance(value, (list, tuple)):
        return [_value(x, user) for x in value]
    return value


@dataclass(frozen=True)
class Match:
    """Which tables: all, one by name, or a namespace."""

    kind: str = "all"
    name: str = ""

    def covers(self, table: Table) -> bool:
        return self.kind == "all" or (self.kind == "exact" and table.name == self.name) or (self.kind == "namespace" and table.namespace == self.name)


@dataclass(frozen=True)
class Policy:
    name: str
    match: Match
    rows: Any = None
    deny: tuple[str, ...] = ()
    mask: dict[str, Any] = field(default_factory=dict)


TENANT_ISOLATION = Policy("tenant_isolation", Match("namespace", "dbo"), Eq("tenant_id", Attribute("tenant_id")))


@dataclass
class Guard:
    """The policies that hold for one user."""

    policies: list[Policy]
    user: User
    apply_security: bool = True
    messages: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not self.apply_security and not self.user.admin:
            raise EngineError("security_bypass_denied", self.user.name)

    def _covering(self, table: Table) -> list[Policy]:
        return [p for p in self.policies if p.match.covers(table)] if self.apply_security else []

    def denied(self, table: Table) -> set[str]:
        return {c for p in self._covering(table) for c in p.deny}

    def view(self, table: Table, df: DataFrame) -> DataFrame:
        """The table as the user may see it."""
        policies = self._covering(table)
        for p in policies:
            if p.rows is not None:
                df = df.filter(p.rows.build(self.user))
        masks = {c: v for p in policies for c, v in p.mask.items()}
        denied = self.denied(table)
        if not masks and not denied:
            return df
        kinds = dict(df.dtypes)
        return df.select(*[F.lit(masks[c]).cast(kinds[c]).alias(c) if c in masks else F.col(f"`{c}`") for c in df.columns if c not in denied])

    def masked(self, table: Table) -> set[str]:
        return {c for p in self._covering(table) for c in p.mask}

    def check_names(self, tables: list[Table], columns: set[str], star: bool = False) -> None:
        """By name, on the side of refusal: a denied column of any table in the plan may not be named anywhere in it."""
        for table in tables:
            hit = self.denied(table) & columns
            if hit or star and self.denied(table):
                raise EngineError("column_denied", ", ".join(sorted(hit or self.denied(table))))

    def warn_masked_keys(self, plan: ir.Node, tables: list[Table]) -> None:
        masked = {c for t in tables for c in self.masked(t)}
        for x in ir.walk(plan):
            keys = [k.name for k in x.keys] if isinstance(x, ir.Aggregate) else [e.name for e, _, _ in x.keys if isinstance(e, ir.Ref)] if isinstance(x, ir.Sort) else []
            if masked & set(keys):
                self.messages.append("mask_skipped_bare_column_ref")


def top_n(df: DataFrame, requested: int | None = None, cap: int = TOP_N) -> DataFrame:
    """At most the smaller of requested and cap rows."""
    return df.limit(cap if requested is None else min(requested, cap))


def cap_root(plan: ir.Node, cap: int = TOP_N) -> ir.Node:
    """The root's limit lowered to the cap, its offset kept; a root without one gets one."""
    if isinstance(plan, ir.Store):
        return ir.Store(plan.target, cap_root(plan.input, cap), plan.mode)
    if isinstance(plan, ir.Limit):
        return ir.Limit(plan.input, cap if plan.limit is None else min(plan.limit, cap), plan.offset)
    return ir.Limit(plan, cap)


def row_limit(df: DataFrame, limit: int = ROW_LIMIT) -> tuple[list, bool]:
    """At most limit rows, and whether there were more (partial_results_truncated)."""
    if not 1 <= limit <= MOST_ROWS:
        raise EngineError("row_limit_out_of_range", f"1 to {MOST_ROWS}")
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def check_strict(plan: ir.Node, types: dict[str, str]) -> None:
    """Refuses comparisons across type families, in every branch and in subqueries."""

    def family(e: ir.Expr) -> str | None:
        if isinstance(e, ir.Ref):
            return scalar.family(types[e.name]) if e.name in types else None
        if isinstance(e, ir.Cast):
            return scalar.family(scalar.spark_type(e.type))
        if isinstance(e, ir.Lit) and e.value is not None:
            if e.type:
                return scalar.family(scalar.spark_type(e.type))
            return "bool" if isinstance(e.value, bool) else "numeric" if isinstance(e.value, (int, float)) else "text" if isinstance(e.value, str) else "temporal"
        return None

    for x in ir.walk(plan):
        if isinstance(x, ir.Call) and x.op in scalar.COMPARISONS:
            found = {f for f in map(family, x.args) if f is not None}
            if len(found) > 1:
                raise EngineError("strict_coercion_rejected", f"{x.op}: {', '.join(sorted(found))}")


def check_layers(plan: ir.Node) -> None:
    """One plan reads entities or tables, not both."""
    kinds = {type(x) for x in ir.walk(plan) if isinstance(x, (ir.TableScan, ir.EntityScan))}
    if len(kinds) > 1:
        raise EngineError("validator_mixed_layer_tree", "entities and tables in one plan")


def check_connections(tables: list[Table], explicit: str | None = None) -> tuple[str | None, list[str]]:
    """The one connection of a plan's tables; an explicit one overrides with a warning."""
    found = sorted({t.connection for t in tables})
    if explicit:
        return explicit, ["connection_id_overrides_derived"] if found and found != [explicit] else []
    if len(found) > 1:
        raise EngineError("cross_database_not_supported", ", ".join(found))
    return (found[0] if found else None), []


_TOKEN = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|`(?:[^`]|``)+`|\"(?:[^\"]|\"\")+\"|[^\W\d]\w*|\*|\S", re.S | re.U)


def sql_names(text: str) -> tuple[set[str], bool]:
    """Identifiers of a SQL text, and whether it selects a star."""
    names, star, before = set(), False, ""
    for token in _TOKEN.findall(text):
        if token.startswith(("'", "--", "/*")):
            continue
        word = token[1:-1] if token[0] in "`\"" and len(token) > 1 else token
        if word == "*" and (before.lower() in ("select", "distinct", ",", "all") or before == "."):
            star = True
        if re.match(r"[^\W\d]", word):
            names.add(word)
        before = token
    return names, star
