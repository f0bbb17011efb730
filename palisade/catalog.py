"""Two layers of model: entities with attributes and relations over tables with columns and keys."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError


@dataclass(frozen=True)
class QName:
    """schema (db, er, obj), namespace, name."""

    schema: str
    namespace: str
    name: str

    @staticmethod
    def parse(text: str) -> "QName":
        parts = text.split(".")
        if len(parts) == 1:
            return QName("db", "main", parts[0])
        if len(parts) == 2:
            return QName("db", parts[0], parts[1])
        return QName(parts[0], ".".join(parts[1:-1]), parts[-1])

    def __str__(self) -> str:
        return f"{self.schema}.{self.namespace}.{self.name}"


@dataclass
class Table:
    name: str
    load: Callable[[SparkSession], DataFrame]
    namespace: str = "main"
    primary_key: tuple[str, ...] = ()
    #: (columns, other table, its columns)
    foreign_keys: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    connection: str = "lake"

    @property
    def qname(self) -> QName:
        return QName("db", self.namespace, self.name)


@dataclass
class Entity:
    """Attributes map to columns; two may share one. where limits the entity to some rows."""

    name: str
    table: str | None
    attributes: dict[str, str]
    where: str | None = None
    query: str | None = None
    labels: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass
class Relation:
    name: str
    source: str
    target: str
    pairs: tuple[tuple[str, str], ...]
    cardinality: str = "0..* -> 0..1"


@dataclass
class SavedQuery:
    name: str
    text: str
    language: str = "sql"
    params: dict[str, str] = field(default_factory=dict)
    state: str = "ready"
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Hit:
    kind: str
    name: str
    score: float
    params: dict[str, str] = field(default_factory=dict)


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    queries: dict[str, SavedQuery] = field(default_factory=dict)
    version: str = "1"

    def table(self, name: str) -> Table:
        found = self.tables.get(QName.parse(name).name if "." in name else name)
        if found is None:
            raise EngineError("table_not_found", name, hint=", ".join(self.suggest(name)))
        return found

    def entity(self, name: str) -> Entity:
        found = self.entities.get(QName.parse(name).name if "." in name else name)
        if found is None:
            raise EngineError("entity_not_found", name, hint=", ".join(self.suggest(name)))
        return found

    def query(self, name: str) -> SavedQuery:
        found = self.queries.get(name.rsplit(".", 1)[-1])
        if found is None:
            raise EngineError("query_not_found", name)
        if found.state != "ready":
            raise EngineError(f"query_{found.state}", name)
        return found

    def suggest(self, name: str) -> list[str]:
        return difflib.get_close_matches(name.rsplit(".", 1)[-1], [*self.tables, *self.entities], 3, 0.6)

    def search(self, text: str, least: float = 0.5, offset: int = 0, limit: int = 50) -> list["Hit"]:
        """Objects by how well a text names them, the best first, ties by kind and name, a page of them.

        A saved query whose pattern finds the text scores 1 and gives the named groups
        as parameters; else the score is the likeness of the words, at best of the name's.
        """
        words = re.findall(r"\w+", text.lower())
        every = [("table", n) for n in self.tables] + [("entity", n) for n in self.entities] + [("relation", n) for n in self.relations] + [("query", n) for n in self.queries]
        hits = []
        for kind, name in every:
            found = next((m for p in (self.queries[name].patterns if kind == "query" else ()) if (m := re.search(p, text, re.I))), None)
            own = name.lower().split("_")
            alike = [max((difflib.SequenceMatcher(None, w, o).ratio() for w in words), default=0.0) for o in own]
            score = 1.0 if found else round(sum(alike) / len(alike), 6)
            if score >= least:
                hits.append(Hit(kind, name, score, {k: v for k, v in (found.groupdict() if found else {}).items() if v is not None}))
        hits.sort(key=lambda h: (-h.score, h.kind, h.name))
        return hits[offset : offset + limit]

    def detect(self, names: list[str]) -> tuple[str, list[str]]:
        """Which layer the names belong to, and suggestions for unknown ones.

        CONFIRMED db or er when one layer knows all, MIXED when both are needed,
        AMBIGUOUS when both know all, UNKNOWN, or NOT_APPLICABLE without names.
        """
        if not names:
            return "NOT_APPLICABLE", []
        unknown = [n for n in names if n not in self.tables and n not in self.entities]
        if unknown:
            return "UNKNOWN", [s for n in unknown for s in self.suggest(n)]
        as_db, as_er = all(n in self.tables for n in names), all(n in self.entities for n in names)
        if as_db and as_er:
            return "AMBIGUOUS", []
        return ("CONFIRMED_DB", []) if as_db else ("CONFIRMED_ER", []) if as_er else ("MIXED", [])

    def relation_condition(self, name: str, left: str, right: str):
        """The equi-join that a relation stands for, between two aliases."""
        relation = self.relations.get(name)
        if relation is None:
            raise EngineError("relation_not_found", name)
        parts = [F.col(f"`{left}`.`{a}`") == F.col(f"`{right}`.`{b}`") for a, b in relation.pairs]
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out

    def edges(self) -> list[tuple[str, str, str]]:
        """The model graph: (from, kind, to) with kinds defines, references, maps_to, uses."""
        out = []
        for t in self.tables.values():
            out += [(t.name, "references", other) for _, other, _ in t.foreign_keys]
        for e in self.entities.values():
            out += [(e.name, "defines", f"{e.name}.{a}") for a in e.attributes]
            if e.table:
                out.append((e.name, "maps_to", e.table))
            if e.query:
                out.append((e.name, "uses", e.query))
        out += [(r.source, "references", r.target) for r in self.relations.values()]
        return sorted(out)

    def listing(self, kind: str | None = None, prefix: str = "", offset: int = 0, limit: int = 1000) -> list[tuple[str, str]]:
        """(kind, name) of objects in order, at most 1000 a page."""
        every = [("table", n) for n in self.tables] + [("entity", n) for n in self.entities] + [("relation", n) for n in self.relations] + [("query", n) for n in self.queries]
        found = sorted(x for x in every if (kind is None or x[0] == kind) and x[1].startswith(prefix))
        return found[offset : offset + min(limit, 1000)]


def parquet_catalog(sf_dir: str) -> Catalog:
    """The driver's tables with their keys, and some entities and relations over them."""
    keys = {
        "region": ("r_regionkey",),
        "nation": ("n_nationkey",),
        "customer": ("c_custkey",),
        "supplier": ("s_suppkey",),
        "part": ("p_partkey",),
        "orders": ("o_orderkey",),
        "lineitem": ("l_orderkey", "l_linenumber"),
        "events": ("event_id",),
        "documents": ("doc_id",),
        "embeddings": ("vec_id",),
        "pages": ("page_id",),
        "benchmark": ("item_id",),
        "labels": ("doc_id",),
        "conversations": ("conv_id", "turn"),
    }
    links = {
        "nation": ((("n_regionkey",), "region", ("r_regionkey",)),),
        "customer": ((("c_nationkey",), "nation", ("n_nationkey",)),),
        "supplier": ((("s_nationkey",), "nation", ("n_nationkey",)),),
        "orders": ((("o_custkey",), "customer", ("c_custkey",)),),
        "lineitem": (
            (("l_orderkey",), "orders", ("o_orderkey",)),
            (("l_partkey",), "part", ("p_partkey",)),
            (("l_suppkey",), "supplier", ("s_suppkey",)),
        ),
    }
    tables = {n: Table(n, lambda spark, n=n: spark.read.parquet(f"{sf_dir}/{n}.parquet"), "main", k, links.get(n, ())) for n, k in keys.items()}
    entities = {
        "Client": Entity("Client", "customer", {"id": "c_custkey", "title": "c_name", "country": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment"}),
        "Builder": Entity("Builder", "customer", {"id": "c_custkey", "title": "c_name", "country": "c_nationkey"}, where="c_mktsegment = 'BUILDING'"),
        "Country": Entity("Country", "nation", {"id": "n_nationkey", "title": "n_name", "area": "n_regionkey"}),
        "Purchase": Entity("Purchase", "orders", {"id": "o_orderkey", "buyer": "o_custkey", "total": "o_totalprice", "placed": "o_orderdate", "state": "o_orderstatus"}),
    }
    relations = {
        "purchase_client": Relation("purchase_client", "Purchase", "Client", (("buyer", "id"),)),
        "client_country": Relation("client_country", "Client", "Country", (("country", "id"),)),
    }
    queries = {
        "open_orders": SavedQuery("open_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'", patterns=(r"open orders(?: of (?P<year>\d{4}))?",)),
        "orders_over": SavedQuery("orders_over", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {least}", params={"least": "float"}),
        "stale": SavedQuery("stale", "SELECT 1", state="failed"),
    }
    return Catalog(tables, entities, relations, queries)
