"""The scalar operations of plans, as columns."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

#: Names of types in plans and casts, with the Spark type of each.
TYPES = {
    "text": "string", "string": "string", "varchar": "string", "char": "string",
    "int": "bigint", "integer": "bigint", "long": "bigint", "bigint": "bigint",
    "float": "double", "double": "double",
    "bool": "boolean", "boolean": "boolean",
    "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "date": "date",
}

FAMILIES = {"bigint": "numeric", "int": "numeric", "smallint": "numeric", "tinyint": "numeric", "double": "numeric", "float": "numeric", "string": "text", "boolean": "bool", "timestamp": "temporal", "timestamp_ntz": "temporal", "date": "temporal"}


def spark_type(name: str) -> str:
    base = name.strip().lower()
    if base.startswith("decimal"):
        return base
    if base.split("(")[0] not in TYPES:
        raise EngineError("unsupported_expression", f"type {name}")
    return TYPES[base.split("(")[0]]


def family(kind: str) -> str:
    return "numeric" if kind.startswith("decimal") else FAMILIES.get(kind, kind)


def like(value: Column, pattern: str) -> Column:
    """% and _ without an escape character, anchored at both ends."""
    return value.like(pattern.replace("\\", "\\\\"))


def fold_sql(column: Column) -> Column:
    """Case and accents folded by a closed alphabet; tx_fold covers all of Unicode."""
    accented = "áàâäãåčçďéèêëěíìîïľĺňñóòôöõőřŕšśťúùûüůűýÿžźż"
    plain = "aaaaaaccdeeeeeiiiillnnoooooorrsstuuuuuuyyzzz"
    return F.translate(F.lower(column), accented, plain)


def collated_like(column: Column, pattern: str) -> Column:
    """LIKE without regard to case and accents: both sides folded."""
    return fold_sql(column).like(_folded(pattern).replace("\\", "\\\\"))


def _folded(text: str) -> str:
    from .text import fold

    return fold(text)


_TWO: dict[str, Callable[[Column, Column], Column]] = {
    "add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "mul": operator.mul, "divide": operator.truediv, "modulo": operator.mod,
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge,
}
_ONE: dict[str, Callable[[Column], Column]] = {
    "negate": operator.neg, "not": operator.invert, "is_null": Column.isNull, "is_not_null": Column.isNotNull,
    "lower": F.lower, "upper": F.upper, "abs": F.abs, "year": F.year, "month": F.month, "trim": F.trim, "length": F.length,
}
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge", "like", "in")


def _arity(op: str, args: list, least: int, most: int | None = None) -> None:
    if len(args) < least or most is not None and len(args) > most:
        raise EngineError("unsupported_expression", f"{op} with {len(args)} operands")


def apply(op: str, args: list[Column], raw: list) -> Column:
    """One operation; raw holds the operands before lowering, for those that must be literals."""
    from ..plans.ir import Lit

    if op in _TWO:
        _arity(op, args, 2, 2)
        return _TWO[op](*args)
    if op in _ONE:
        _arity(op, args, 1, 1)
        return _ONE[op](args[0])
    if op in ("and", "or"):
        _arity(op, args, 1)
        return reduce(operator.and_ if op == "and" else operator.or_, args)
    if op == "between":
        _arity(op, args, 3, 3)
        return args[0].between(args[1], args[2])
    if op == "in":
        _arity(op, args, 2)
        if not all(isinstance(x, Lit) for x in raw[1:]):
            raise EngineError("unsupported_expression", "in takes literals")
        return args[0].isin(*[x.value for x in raw[1:]])
    if op == "coalesce":
        _arity(op, args, 1)
        return F.coalesce(*args)
    if op == "concat":
        _arity(op, args, 1)
        return F.concat(*args)
    if op == "like":
        _arity(op, args, 2, 2)
        if not isinstance(raw[1], Lit):
            raise EngineError("unsupported_expression", "like takes a literal pattern")
        return like(args[0], raw[1].value)
    if op == "nullif":
        _arity(op, args, 2, 2)
        return F.nullif(*args)
    if op == "round":
        _arity(op, args, 1, 2)
        return F.round(args[0], raw[1].value if len(raw) > 1 else 0)
    if op == "substring":
        _arity(op, args, 3, 3)
        return F.substring(args[0], raw[1].value, raw[2].value)
    if op == "case":
        _arity(op, args, 2)
        out = None
        for when, then in zip(args[::2], args[1::2]):
            out = F.when(when, then) if out is None else out.when(when, then)
        return out.otherwise(args[-1]) if len(args) % 2 else out
    from . import grounding

    if op in grounding.CATALOG:
        return grounding.CATALOG[op](*args)
    raise EngineError("unsupported_expression", op)


AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def aggregate(function: str, arg: Column | None, distinct: bool) -> Column:
    """SQL semantics: nulls are not counted, the sum of nothing is null."""
    name = function.lower()
    if name == "count_distinct" or name == "count" and distinct:
        if arg is None:
            raise EngineError("unsupported_expression", "count distinct of nothing")
        return F.count_distinct(arg)
    if name == "count" and arg is None:
        return F.count(F.lit(1))
    if name not in AGGREGATES or arg is None:
        raise EngineError("unsupported_expression", function)
    return F.sum_distinct(arg) if name == "sum" and distinct else AGGREGATES[name](arg)
