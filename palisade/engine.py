"""One entry for all source languages: parse, bind, guard, run."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Entity, SavedQuery
from .errors import EngineError
from .operators.govern import Guard, Policy, User, cap_root, check_connections, check_layers, check_strict, sql_names
from .plans import frontends, ir
from .plans.lower import Lowering


@dataclass
class Options:
    """How a query runs; top_n None leaves the root as it is."""

    params: dict[str, Any] = field(default_factory=dict)
    top_n: int | None = None
    strict: bool = False
    apply_security: bool = True
    source_schema: str = "auto"
    connection: str | None = None
    #: Called with what was compiled before it runs; raises to refuse.
    review: Callable[["Compiled"], None] | None = None


@dataclass
class Compiled:
    """A bound query and what it touches."""

    language: str
    text: str
    plan: ir.Node | None
    used: list[str]
    layer: str
    params: tuple[str, ...]
    cached: bool = False
    messages: list[str] = field(default_factory=list)


class PlanCache:
    """The latest compiled texts, each for a while. Guards are never kept."""

    def __init__(self, size: int = 1000, seconds: float = 3600, clock=time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.items: OrderedDict[str, tuple[float, Compiled]] = OrderedDict()

    def get(self, key: str) -> Compiled | None:
        found = self.items.get(key)
        if found is None or self.clock() - found[0] > self.seconds:
            self.items.pop(key, None)
            return None
        self.items.move_to_end(key)
        return found[1]

    def put(self, key: str, value: Compiled) -> None:
        self.items[key] = (self.clock(), value)
        self.items.move_to_end(key)
        while len(self.items) > self.size:
            self.items.popitem(last=False)


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, policies: list[Policy] | None = None, user: User | None = None, workspace=None):
        self.spark, self.catalog = spark, catalog
        self.policies, self.user, self.workspace = policies or [], user or User("main:anyone"), workspace
        self.cache = PlanCache()

    def compile(self, text: str, language: str = "sql", options: Options | None = None) -> Compiled:
        options = options or Options()
        kinds = sorted((k, type(v).__name__) for k, v in options.params.items())
        key = hashlib.sha256(repr((self.catalog.version, text, language, options.source_schema, kinds)).encode()).hexdigest()
        found = self.cache.get(key)
        if found is not None:
            return Compiled(**{**vars(found), "cached": True, "messages": []})
        if language == "sql":
            names, _ = sql_names(text)
            used = sorted(n for n in names if n in self.catalog.tables or n in self.catalog.entities)
            layer, _ = self.catalog.detect(used)
            out = Compiled(language, text, None, used, layer, tuple(dict.fromkeys(frontends._PARAM.findall(text))))
        else:
            plan = self._parse(text, language)
            used = ir.scan_set(plan)
            out = Compiled(language, text, plan, used, self.catalog.detect(used)[0], tuple(dict.fromkeys(x.name for x in ir.walk(plan) if isinstance(x, ir.Param))))
        self.cache.put(key, out)
        return out

    def _parse(self, text: str, language: str) -> ir.Node:
        if language == "dfdsl":
            return frontends.dfdsl(text)
        if language == "transdsl":
            return frontends.transdsl(text, self.catalog, self._saved_plan)
        if language == "relnode":
            return frontends.relnode(text)
        raise EngineError("unsupported_language", language)

    def _saved_plan(self, query: SavedQuery) -> ir.Node:
        return self._parse(query.text, query.language) if query.language != "sql" else ir.EntityScan(f"query:{query.name}")

    def _guard(self, options: Options) -> Guard:
        return Guard(self.policies, self.user, options.apply_security)

    def table(self, name: str, guard: Guard) -> DataFrame:
        table = self.catalog.table(name)
        return guard.view(table, table.load(self.spark))

    def entity(self, name: str, guard: Guard, options: Options | None = None) -> DataFrame:
        """An entity's attributes over the guarded view of its table, or over its saved query."""
        if name.startswith("query:"):
            return self._sql(self.catalog.query(name[6:]).text, guard, options or Options())
        e: Entity = self.catalog.entity(name)
        base = self._sql(self.catalog.query(e.query).text, guard, options or Options()) if e.query else self.table(e.table, guard)
        hidden = [c for c in e.attributes.values() if c not in base.columns]
        if e.where:
            base = base.filter(e.where)
        return base.select(*[F.col(f"`{c}`").alias(a) for a, c in e.attributes.items() if c not in hidden])

    def run(self, text: str, language: str = "sql", options: Options | None = None) -> DataFrame:
        """The guarded result as a DataFrame; nothing runs until an action."""
        options = options or Options()
        compiled = self.compile(text, language, options)
        if options.review is not None:
            options.review(compiled)
        guard = self._guard(options)
        if language == "sql":
            df = self._sql(text, guard, options)
            return df if options.top_n is None else df.limit(options.top_n)
        plan = compiled.plan
        check_layers(_without_saved(plan))
        tables = [self.catalog.tables[n] for n in compiled.used if n in self.catalog.tables]
        tables += [self.catalog.tables[e.table] for n in compiled.used if (e := self.catalog.entities.get(n)) and e.table]
        check_connections(tables, options.connection)
        columns = ir.column_names(plan)
        columns |= {self.catalog.entities[n].attributes.get(c, c) for n in compiled.used if n in self.catalog.entities for c in columns}
        guard.check_names(tables, columns)
        if options.strict:
            check_strict(plan, {c: k for t in tables for c, k in t.load(self.spark).dtypes})
        guard.warn_masked_keys(plan, tables)
        if options.top_n is not None:
            plan = cap_root(plan, options.top_n)
        workspace = (lambda name: self.workspace.get(self.user.name, name)) if self.workspace is not None else None
        lowering = Lowering(self.spark, lambda n: self.table(n, guard), lambda n: self.entity(n, guard, options), workspace, options.params)
        return lowering.frame(plan)

    def _sql(self, text: str, guard: Guard, options: Options) -> DataFrame:
        """SQL over guarded views in a session of their own, so views of one run are unseen by another."""
        names, star = sql_names(text)
        tables = [self.catalog.tables[n] for n in sorted(names) if n in self.catalog.tables]
        entities = [self.catalog.entities[n] for n in sorted(names) if n in self.catalog.entities]
        if tables and entities:
            raise EngineError("validator_mixed_layer_tree", "entities and tables in one plan")
        check_connections(tables, options.connection)
        base = [self.catalog.tables[e.table] for e in entities if e.table]
        mapped = {e.attributes[a] for e in entities for a in names if a in e.attributes}
        guard.check_names(tables, names, star)
        guard.check_names(base, mapped, False)
        bound, args = frontends.bind_sql(frontends.shim_sql(text), options.params)
        session = self.spark.newSession()
        for t in tables:
            _in(session, self.table(t.name, guard)).createOrReplaceTempView(t.name)
        for e in entities:
            _in(session, self.entity(e.name, guard, options)).createOrReplaceTempView(e.name)
        try:
            return _in(self.spark, session.sql(bound, args=args))
        except AnalysisException as e:
            raise EngineError("validation_failed", e.getCondition() or "analysis") from e

    def store(self, text: str, language: str, mover, options: Options | None = None) -> str:
        """Runs a plan whose root stores, and writes its guarded rows to the target."""
        plan = self.compile(text, language, options).plan
        if not isinstance(plan, ir.Store):
            raise EngineError("unsupported_node", "the root does not store")
        from .sources.transfer import BLOB, TABLE, Location

        kind, _, name = plan.target.rpartition(":")
        mover.write(self.run(text, language, options), Location(BLOB if kind == "blob" else TABLE, name), plan.mode)
        return plan.target

    def explain(self, text: str, language: str = "sql", options: Options | None = None) -> str:
        return self.run(text, language, options)._jdf.queryExecution().toString()

    def traverse(self, start: str, kinds: tuple[str, ...] = (), direction: str = "out", depth: int = 10) -> DataFrame:
        from .operators.graph import traverse

        edges = self.spark.createDataFrame(self.catalog.edges(), "src string, kind string, dst string")
        return traverse(edges, start, kinds, direction, depth)


def _in(session: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows for use in a sibling session of one application."""
    rows = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(rows, session)


def _without_saved(plan: ir.Node) -> ir.Node:
    """Saved SQL stands in plans as a scan of its own; it is guarded when it is read."""
    return ir.rebuild(plan, lambda x: ir.Values((), ()) if isinstance(x, ir.EntityScan) and x.entity.startswith("query:") else x)
