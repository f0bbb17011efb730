"""Plans to DataFrames. What runs, and how, is Catalyst's to decide."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import scalar
from . import ir

_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


@dataclass
class Lowering:
    """Turns plans into DataFrames with given sources and parameters."""

    spark: SparkSession
    table: Callable[[str], DataFrame]
    entity: Callable[[str], DataFrame] | None = None
    workspace: Callable[[str], DataFrame] | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def frame(self, node: ir.Node) -> DataFrame:
        handler = getattr(self, "_" + type(node).__name__.lower(), None)
        if handler is None:
            raise EngineError("unsupported_node", type(node).__name__)
        return handler(node)

    def _tablescan(self, node: ir.TableScan) -> DataFrame:
        df = self.table(node.table)
        return (df.select(*node.columns) if node.columns else df).alias(node.table.rsplit(".", 1)[-1])

    def _entityscan(self, node: ir.EntityScan) -> DataFrame:
        if self.entity is None:
            raise EngineError("unsupported_node", "no entities here")
        df = self.entity(node.entity)
        return (df.select(*node.columns) if node.columns else df).alias(node.entity.rsplit(".", 1)[-1])

    def _workspaceref(self, node: ir.WorkspaceRef) -> DataFrame:
        if self.workspace is None:
            raise EngineError("workspace_requires_session", node.name)
        return self.workspace(node.name).alias(node.name)

    def _values(self, node: ir.Values) -> DataFrame:
        if not node.columns:
            return self.spark.createDataFrame([], T.StructType([]))
        schema = ", ".join(f"`{name}` {scalar.spark_type(kind)}" for name, kind in node.columns)
        return self.spark.createDataFrame([tuple(row) for row in node.rows], schema)

    def _project(self, node: ir.Project) -> DataFrame:
        return self.frame(node.input).select(*[self.column(e).alias(name) for e, name in node.items])

    def _filter(self, node: ir.Filter) -> DataFrame:
        df = self.frame(node.input)
        rest: list[ir.Expr] = []
        for part in _conjuncts(node.condition):
            joined = self._by_subquery(df, part)
            if joined is None:
                rest.append(part)
            else:
                df = joined
        for part in rest:
            df = df.filter(self.column(part))
        return df

    def _by_subquery(self, df: DataFrame, part: ir.Expr) -> DataFrame | None:
        """IN, EXISTS and their negations as semi and anti joins, with SQL's treatment of nulls."""
        negated = isinstance(part, ir.Call) and part.op == "not" and len(part.args) == 1
        inner = part.args[0] if negated else part
        if not isinstance(inner, ir.Sub) or inner.kind not in ("in", "exists"):
            return None
        sub = self.frame(inner.plan)
        if inner.kind == "exists":
            found = sub.limit(1).select(F.lit(1).alias("__one"))
            return df.join(found, F.lit(True), "left_anti" if negated else "left_semi")
        if len(inner.operands) != len(sub.columns):
            raise EngineError("unsupported_expression", "in with another number of columns")
        names = [f"__in{k}" for k in range(len(sub.columns))]
        sub = sub.toDF(*names)
        same = [self.column(x) == F.col(n) for x, n in zip(inner.operands, names)]
        on = same[0]
        for x in same[1:]:
            on = on & x
        # With NOT IN a row stays only where every comparison is false; Spark knows this form as a null-aware anti join.
        return df.join(sub, on | on.isNull(), "left_anti") if negated else df.join(sub, on, "left_semi")

    def _join(self, node: ir.Join) -> DataFrame:
        left, right = self.frame(node.left), self.frame(node.right)
        if node.how not in _HOW:
            raise EngineError("unsupported_node", f"join {node.how}")
        if node.condition is None:
            if node.how != "inner":
                raise EngineError("unsupported_node", f"{node.how} join without a condition")
            return left.crossJoin(right)
        return left.join(right, self.column(node.condition), _HOW[node.how])

    def _union(self, node: ir.Union) -> DataFrame:
        if not node.inputs:
            raise EngineError("unsupported_node", "union of nothing")
        frames = [self.frame(x) for x in node.inputs]
        out = frames[0]
        for df in frames[1:]:
            if len(df.columns) != len(out.columns):
                raise EngineError("unsupported_node", "union of different widths")
            out = out.unionAll(df)
        return out

    def _aggregate(self, node: ir.Aggregate) -> DataFrame:
        df = self.frame(node.input)
        calls = [scalar.aggregate(f, None if a is None else self.column(a), d).alias(name) for f, a, d, name in node.calls]
        if not node.keys:
            return df.agg(*calls)
        keys = [self.column(k).alias(k.name) for k in node.keys]
        return df.groupBy(*keys).agg(*calls) if calls else df.select(*keys).distinct()

    def order(self, keys: tuple[tuple[ir.Expr, bool, bool], ...]) -> list[Column]:
        out = []
        for e, descending, nulls_first in keys:
            c = self.column(e)
            out.append((c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if nulls_first else c.asc_nulls_last()))
        return out

    def _sort(self, node: ir.Sort) -> DataFrame:
        return self.frame(node.input).orderBy(*self.order(node.keys))

    def _limit(self, node: ir.Limit) -> DataFrame:
        df = self.frame(node.input)
        if node.offset:
            df = df.offset(node.offset)
        return df if node.limit is None else df.limit(node.limit)

    def _subquery(self, node: ir.Subquery) -> DataFrame:
        return self.frame(node.plan).alias(node.alias)

    def _store(self, node: ir.Store) -> DataFrame:
        return self.frame(node.input)

    def column(self, e: ir.Expr) -> Column:
        if isinstance(e, ir.Ref):
            return F.col(f"`{e.source}`.`{e.name}`" if e.source else f"`{e.name}`")
        if isinstance(e, ir.Lit):
            return self._literal(e)
        if isinstance(e, ir.Param):
            if e.name not in self.params:
                raise EngineError("parameter_unknown", e.name)
            return F.lit(self.params[e.name])
        if isinstance(e, ir.Cast):
            return self.column(e.value).try_cast(scalar.spark_type(e.type))
        if isinstance(e, ir.Call):
            return scalar.apply(e.op, [self.column(x) for x in e.args], list(e.args))
        if isinstance(e, ir.Over):
            return self._over(e)
        if isinstance(e, ir.Sub) and e.kind == "scalar":
            return self.frame(e.plan).scalar()
        if isinstance(e, ir.Sub) and e.kind == "exists":
            return self.frame(e.plan).exists()
        raise EngineError("unsupported_expression", type(e).__name__)

    @staticmethod
    def _literal(e: ir.Lit) -> Column:
        if e.type is None:
            return F.lit(e.value)
        if e.value is None:
            return F.lit(None).cast("string" if e.type == "null" else scalar.spark_type(e.type))
        return F.lit(e.value).cast(scalar.spark_type(e.type))

    def _over(self, e: ir.Over) -> Column:
        window = Window.partitionBy(*[self.column(x) for x in e.partition])
        if e.order:
            window = window.orderBy(*self.order(e.order))
        if e.rows is not None:
            lo, hi = (Window.unboundedPreceding if e.rows[0] is None else e.rows[0]), (Window.unboundedFollowing if e.rows[1] is None else e.rows[1])
            window = window.rowsBetween(lo, hi)
        args = [self.column(x) for x in e.args]
        ranks = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
        if e.op in ranks:
            return ranks[e.op]().over(window)
        if e.op in ("lag", "lead"):
            return getattr(F, e.op)(args[0], e.args[1].value if len(e.args) > 1 else 1).over(window)
        return scalar.aggregate(e.op, args[0] if args else None, False).over(window)


def _conjuncts(e: ir.Expr) -> list[ir.Expr]:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, ir.Call) and e.op == "and" else [e]
