"""The queries of the reference inventory, each with SQL for the same rows.

A query takes (spark, sf_dir) and returns a DataFrame. Keys are those of the
inventory. Queries go through the engine, its front ends and its operators; the
SQL is written independently of them.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import tempfile
import uuid
import zipfile
from xml.etree import ElementTree
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, QName, Table, parquet_catalog
from ..engine import Engine, Options
from ..errors import EngineError
from ..functions import grounding, text
from ..operators import annotate, formats, fuzzy, rank
from ..operators.fingerprint import of_frame
from ..operators.govern import TENANT_ISOLATION, And, Attribute, Eq, In, Match, Not, Or, Policy, User, check_connections, top_n
from ..operators.workspace import Workspace
from ..sources import readers
from ..sources.transfer import DERBY, Location, Mover, packed_database
from ..streaming import events as streams
from . import frontends, ir
from .ir import Aggregate, Call, Cast, Filter, Join, Limit, Lit, Over, Param, Project, Ref, Sort, Sub, Subquery, TableScan, Union, Values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, policies: list[Policy] | None = None, user: User | None = None, workspace: Workspace | None = None) -> Engine:
    return Engine(spark, parquet_catalog(sf_dir), policies, user, workspace)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None):
    """Registers a function as the query of a key."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return add


def plan_query(name: str, plan: ir.Node, oracle: str, params: dict | None = None) -> None:
    """A query given as a plan, which travels as JSON to the engine."""
    text_ = json.dumps(frontends.to_wire(plan), default=str)
    query(name, oracle)(lambda spark, sf: engine(spark, sf).run(text_, "relnode", Options(params=params or {})))


def sql_query(name: str, sql: str, oracle: str | None = None, params: dict | None = None) -> None:
    """A query given as SQL text; without a text of its own the oracle runs the same one."""
    query(name, oracle or sql)(lambda spark, sf: engine(spark, sf).run(sql, "sql", Options(params=params or {})))


def call(op: str, *args) -> Call:
    return Call(op, tuple(a if isinstance(a, ir.Expr) else Lit(a) for a in args))


def project(node: ir.Node, **items) -> Project:
    return Project(node, tuple((e if isinstance(e, ir.Expr) else Ref(e), n) for n, e in items.items()))


def total(expr: str, alias: str) -> str:
    return f"round(sum({expr}), 2) AS {alias}"


# --- scans and sources -------------------------------------------------------------------------

NATION, REGION, CUSTOMER, ORDERS, LINEITEM, PART, SUPPLIER, EVENTS = map(TableScan, ("nation", "region", "customer", "orders", "lineitem", "part", "supplier", "events"))

plan_query("src_table", TableScan("nation", ("n_nationkey", "n_name")), "SELECT n_nationkey, n_name FROM nation")
query("src_entity", "SELECT c_custkey AS id, c_name AS title, c_nationkey AS country FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda spark, sf: engine(spark, sf).run(json.dumps({"ops": [{"from": {"entity": "Builder"}}]}), "dfdsl")
)


@query("src_workspace", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def _src_workspace(spark, sf):
    space = Workspace()
    e = engine(spark, sf, workspace=space)
    space.put(e.user.name, "large", e.run("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"))
    return e.run(json.dumps({"ops": [{"from": {"workspace": "large"}}]}), "dfdsl")


plan_query(
    "src_values",
    Values((("id", "int"), ("name", "text"), ("share", "float")), ((1, "one", 0.5), (2, None, 1.5))),
    "SELECT * FROM (VALUES (1::BIGINT, 'one', 0.5::DOUBLE), (2, NULL, 1.5)) v(id, name, share)",
)
query("src_query_ref", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")(
    lambda spark, sf: engine(spark, sf).run(json.dumps({"core": [{"queryRef": "obj.q.open_orders", "alias": "oo"}], "columns": ["o_orderkey", "o_totalprice"]}), "transdsl")
)
query("src_vocab", "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id, p_name AS value, 'part' AS category FROM part WHERE p_name IS NOT NULL")(
    lambda spark, sf: readers.vocabulary(table(spark, sf, "part"), "p_partkey", "p_name", "part")
)
query("src_json_rows", "SELECT * FROM (VALUES (1::BIGINT, 'x', NULL::DOUBLE), (2, NULL, 2.5)) v(a, b, c)")(
    lambda spark, sf: readers.json_rows(spark, '[{"a": 1, "b": "x"}, {"a": 2, "c": 2.5}]')
)


@query("src_arrow_batches", "SELECT * FROM (VALUES (1::BIGINT, 'p'), (2, 'q'), (3, NULL)) v(n, s)")
def _src_arrow_batches(spark, sf):
    schema = pa.schema([("n", pa.uint32()), ("s", pa.string())])
    parts = [([], []), ([1, 2], ["p", "q"]), ([3], [None])]
    return readers.arrow_batches(spark, [pa.RecordBatch.from_arrays([pa.array(a, pa.uint32()), pa.array(b, pa.string())], schema=schema) for a, b in parts])


@query("src_import_df", "SELECT n_nationkey, n_name FROM nation")
def _src_import_df(spark, sf):
    """Arrow batches out of one frame and into a session frame."""
    space = Workspace()
    frame = readers.arrow_batches(spark, list(formats.arrow_batches(table(spark, sf, "nation").select("n_nationkey", "n_name"), 10)))
    space.put("s1", "nations", frame)
    return space.get("s1", "nations")


# --- projection, filter, predicates ------------------------------------------------------------

plan_query(
    "proj_expr",
    project(LINEITEM, key="l_orderkey", line="l_linenumber", net=call("round", call("multiply", Ref("l_extendedprice"), call("subtract", 1, Ref("l_discount"))), 6)),
    "SELECT l_orderkey AS key, l_linenumber AS line, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem",
)
plan_query("filt", Filter(CUSTOMER, call("gt", Ref("c_acctbal"), 5000.0)), "SELECT * FROM customer WHERE c_acctbal > 5000")
query("proj_hide", "SELECT c_custkey, c_name, c_mktsegment FROM customer")(lambda spark, sf: formats.hide(table(spark, sf, "customer"), ["bal$", "^c_nation"]))
query("proj_rownum", 'SELECT row_number() OVER (ORDER BY n_name) AS "#", n_name FROM nation')(
    lambda spark, sf: formats.number_rows(table(spark, sf, "nation").select("n_name"), F.col("n_name")).withColumn("#", F.col("#").cast("long"))
)
query("proj_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'offen' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS state FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", formats.labelled(F.col("o_orderstatus"), {"de": {"O": "offen"}, "en": {"O": "open", "F": "final"}}, "de").alias("state"))
)
plan_query(
    "subq_alias",
    project(Subquery(Filter(NATION, call("eq", Ref("n_regionkey"), 1)), "s"), name=Ref("n_name", "s")),
    "SELECT s.n_name AS name FROM (SELECT * FROM nation WHERE n_regionkey = 1) s",
)
sql_query("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n")
sql_query("param", "SELECT o_orderkey FROM orders WHERE o_orderstatus = {state} AND o_totalprice > {least}", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000", {"state": "F", "least": 150000.0})
sql_query("opt_param", "SELECT c_custkey FROM customer WHERE ({seg} = '' OR c_mktsegment = {seg}) AND ({name} = '' OR c_name = {name})", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'", {"seg": "MACHINERY", "name": ""})
plan_query(
    "subq_in",
    project(Filter(CUSTOMER, call("not", Sub("in", project(Filter(ORDERS, call("gt", Ref("o_totalprice"), 250000.0)), k="o_custkey"), (Ref("c_custkey"),)))), c_custkey="c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
)
sql_query("subq_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
sql_query("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
plan_query(
    "scalar_sub",
    project(Filter(ORDERS, call("eq", Ref("o_totalprice"), Sub("scalar", Aggregate(ORDERS, (), (("max", Ref("o_totalprice"), False, "m"),))))), o_orderkey="o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)",
)

# --- joins -------------------------------------------------------------------------------------


def _join(how: str, condition: ir.Expr | None = call("eq", Ref("c_nationkey"), Ref("n_nationkey"))) -> Project:
    few = Filter(NATION, call("lt", Ref("n_nationkey"), 12))
    some = Filter(CUSTOMER, call("gt", Ref("c_nationkey"), 5))
    return project(Join(some, few, how, condition), c_custkey="c_custkey", n_name="n_name")


_SIDES = "(SELECT * FROM customer WHERE c_nationkey > 5) c {} JOIN (SELECT * FROM nation WHERE n_nationkey < 12) n ON c_nationkey = n_nationkey"
for _how in ("inner", "left", "right", "full"):
    plan_query(f"join_{_how}", _join(_how), f"SELECT c_custkey, n_name FROM {_SIDES.format(_how.upper())}")
plan_query("join_cross", project(Join(NATION, REGION), n_name="n_name", r_name="r_name"), "SELECT n_name, r_name FROM nation CROSS JOIN region")
plan_query(
    "join_nonequi",
    project(Join(NATION, REGION, "inner", call("gt", Ref("n_nationkey"), call("multiply", Ref("r_regionkey"), 5))), n_name="n_name", r_name="r_name"),
    "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey > r_regionkey * 5",
)
plan_query(
    "join_left_residual",
    Aggregate(project(Join(CUSTOMER, ORDERS, "left", call("and", call("eq", Ref("c_custkey"), Ref("o_custkey")), call("eq", Ref("o_orderstatus"), "P"))), c_custkey="c_custkey", o_orderkey="o_orderkey"), (Ref("c_custkey"),), (("count", Ref("o_orderkey"), False, "n"),)),
    "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
)
plan_query(
    "join_self",
    project(Join(Subquery(NATION, "a"), Subquery(NATION, "b"), "inner", call("and", call("eq", Ref("n_regionkey", "a"), Ref("n_regionkey", "b")), call("lt", Ref("n_nationkey", "a"), Ref("n_nationkey", "b")))), one=Ref("n_name", "a"), two=Ref("n_name", "b")),
    "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)
sql_query("join_subq_on", "SELECT n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey = (SELECT max(r_regionkey) FROM region)")
query("join_relation", "SELECT o_orderkey AS id, c_name AS title FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda spark, sf: (lambda e, g: e.entity("Purchase", g).alias("p").join(e.entity("Client", g).alias("c"), e.catalog.relation_condition("purchase_client", "p", "c")).select("p.id", "c.title"))(e := engine(spark, sf), e._guard(Options()))
)
plan_query(
    "join_semi",
    project(Filter(SUPPLIER, Sub("in", project(Filter(LINEITEM, call("gt", Ref("l_quantity"), 49.0)), k="l_suppkey"), (Ref("s_suppkey"),))), s_suppkey="s_suppkey"),
    "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
)
plan_query(
    "join_anti",
    project(Join(PART, Filter(LINEITEM, call("gt", Ref("l_quantity"), 45.0)), "anti", call("eq", Ref("p_partkey"), Ref("l_partkey"))), p_partkey="p_partkey"),
    "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
)

# --- time, money, place ------------------------------------------------------------------------

_PERIODS = [("202401", dt.date(2024, 1, 1), dt.date(2024, 2, 1)), ("199903", dt.date(1999, 3, 1), dt.date(1999, 4, 1)), ("200005", dt.date(2000, 5, 1), dt.date(2000, 6, 1))]
_RATES = [("EUR", "CZK", 25.0, dt.date(1990, 1, 1), dt.date(1998, 1, 1)), ("EUR", "CZK", 24.0, dt.date(1998, 1, 1), dt.date(2030, 1, 1)), ("USD", "CZK", 20.0, dt.date(1990, 1, 1), dt.date(2030, 1, 1))]
_PLACES = [("harbour", 50.0, 14.0), ("mill", 49.5, 14.5), ("tower", 50.2, 14.1)]


def _periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PERIODS, "period string, start_date date, end_date date")


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RATES, "from_ccy string, to_ccy string, rate double, valid_from date, valid_to date")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Customers spread over a grid of coordinates."""
    return table(spark, sf, "customer").select("c_custkey", (F.lit(49.0) + (F.col("c_custkey") % 20) * 0.1).alias("lat"), (F.lit(13.5) + (F.col("c_custkey") % 13) * 0.1).alias("lon"))


_POINTS = "(SELECT c_custkey, 49.0 + (c_custkey % 20) * 0.1::DOUBLE AS lat, 13.5 + (c_custkey % 13) * 0.1::DOUBLE AS lon FROM customer)"
_DISTANCE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians({0} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin(radians({1} - lon) / 2), 2)))"

query("join_interval", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2000-05-01' AND o_orderdate < DATE '2000-06-01'")(
    lambda spark, sf: grounding.period_join(table(spark, sf, "orders"), _periods(spark), "o_orderdate", "200005").select("o_orderkey")
)
query("join_asof_validity", "SELECT o_orderkey, round(o_totalprice * CASE WHEN o_orderdate < DATE '1998-01-01' THEN 25.0 ELSE 24.0 END, 2) AS domestic FROM orders")(
    lambda spark, sf: grounding.fx_validity(table(spark, sf, "orders").withColumn("ccy", F.lit("EUR")), _rates(spark), "ccy", "o_orderdate", "o_totalprice", "CZK").select("o_orderkey", F.round("domestic", 2).alias("domestic"))
)
query("join_poi_distance", f"SELECT c_custkey FROM {_POINTS} WHERE {_DISTANCE.format('50.0', '14.0')} <= 30000")(
    lambda spark, sf: grounding.near_place(_points(spark, sf), spark.createDataFrame(_PLACES, "name string, lat double, lon double"), "harbour", 30000.0).select("c_custkey")
)
query("gr_interval", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1999-03-01' AND o_orderdate < DATE '1999-04-01'")(
    lambda spark, sf: table(spark, sf, "orders").filter(grounding.recognise_date("March 1999", dt.date(2024, 5, 15)).predicate(F.col("o_orderdate"))).select("o_orderkey")
)
query("gr_period_fn", "SELECT code, make_date(CAST(substr(code, 1, 4) AS INTEGER), CAST(substr(code, 5, 2) AS INTEGER), CAST(CASE WHEN length(code) = 8 THEN substr(code, 7, 2) ELSE '01' END AS INTEGER)) AS first, CASE code WHEN '202402' THEN DATE '2024-03-01' WHEN '202312' THEN DATE '2024-01-01' ELSE DATE '2024-03-01' END AS after FROM (VALUES ('202402'), ('202312'), ('20240229')) v(code)")(
    lambda spark, sf: spark.createDataFrame([("202402",), ("202312",), ("20240229",)], "code string").select("code", grounding.period_start(F.col("code")).alias("first"), grounding.period_end(F.col("code")).alias("after"))
)
query("gr_period_join", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= DATE '1999-03-01' AND o_orderdate < DATE '1999-04-01'")(
    lambda spark, sf: grounding.period_join(table(spark, sf, "orders"), _periods(spark), "o_orderdate", "199903").agg(F.count(F.lit(1)).alias("n"))
)
query("gr_period_code", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m') = '200005'")(
    lambda spark, sf: table(spark, sf, "orders").withColumn("code", F.date_format("o_orderdate", "yyyyMM")).filter(F.col("code") == grounding.recognise_date("period 200005", dt.date(2024, 5, 15)).code).select("o_orderkey")
)
query("gr_code_format", "SELECT * FROM (VALUES ('202405', '2024-05', '2024/05', '202405')) v(code, dash, slash, bare)")(
    lambda spark, sf: spark.createDataFrame([("202405",)], "code string").select("code", grounding.period_code(F.col("code"), "yyyy-MM").alias("dash"), grounding.period_code(F.lit("2024-05"), "yyyy/MM").alias("slash"), grounding.period_code(F.lit("2024/05"), "yyyyMM").alias("bare"))
)
_SPANS = ("today", "yesterday", "this week", "last month", "last 10 days", "last 2 months", "letos", "minulý týden", "15.3.2026", "2026-03-15", "5. května 2026", "May 2026", "fiscal year 2025", "poslední čtvrtletí", "202605")


@query(
    "gr_relative",
    """SELECT span, CAST(a AS DATE) AS first, CAST(b AS DATE) AS after FROM (VALUES ('today', '2026-05-20', '2026-05-21'), ('yesterday', '2026-05-19', '2026-05-20'), ('this week', '2026-05-18', '2026-05-25'),
    ('last month', '2026-04-01', '2026-05-01'), ('last 10 days', '2026-05-10', '2026-05-21'), ('last 2 months', '2026-03-20', '2026-05-21'), ('letos', '2026-01-01', '2027-01-01'), ('minulý týden', '2026-05-11', '2026-05-18'),
    ('15.3.2026', '2026-03-15', '2026-03-16'), ('2026-03-15', '2026-03-15', '2026-03-16'), ('5. května 2026', '2026-05-05', '2026-05-06'), ('May 2026', '2026-05-01', '2026-06-01'), ('fiscal year 2025', '2025-01-01', '2026-01-01'),
    ('poslední čtvrtletí', '2026-01-01', '2026-04-01'), ('202605', '2026-05-01', '2026-06-01')) v(span, a, b)""",
)
def _gr_relative(spark, sf):
    found = [(s, grounding.recognise_date(s, dt.date(2026, 5, 20))) for s in _SPANS]
    return spark.createDataFrame([(s, x.start if x else None, x.end if x else None) for s, x in found], "span string, first date, after date")




#: A day written in four ways by its number: ISO, d. m. yyyy, month by name, and as a period's code.
_DAY_FORMS = ("yyyy-MM-dd", "d. M. yyyy", "MMMM d, yyyy", "'period' yyyyMM")


@query(
    "gr_dates",
    """SELECT DISTINCT CASE day(d) % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%-d. %-m. %Y') WHEN 2 THEN strftime(d, '%B %-d, %Y') ELSE 'period ' || strftime(d, '%Y%m') END AS span,
    CASE WHEN day(d) % 4 = 3 THEN CAST(date_trunc('month', d) AS DATE) ELSE d END AS first, CAST(CASE WHEN day(d) % 4 = 3 THEN date_trunc('month', d) + INTERVAL 1 MONTH ELSE d + INTERVAL 1 DAY END AS DATE) AS after,
    CASE WHEN day(d) % 4 = 3 THEN strftime(d, '%Y%m') END AS code FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def _gr_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    form = F.dayofmonth(day) % 4
    text_ = F.coalesce(*[F.when(form == k, F.date_format(day, f)) for k, f in enumerate(_DAY_FORMS)])
    return grounding.read_dates(table(spark, sf, "orders").select(text_.alias("span")), dt.date(2026, 5, 20))


query("gr_money_cmp", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 180000 AND o_totalprice <= 220000")(
    lambda spark, sf: table(spark, sf, "orders").filter(grounding.recognise_money("about 200k").predicate(F.col("o_totalprice"))).select("o_orderkey")
)




@query(
    "gr_money_parse",
    """SELECT DISTINCT CASE k WHEN 0 THEN 'more than ' || format('{:,}', n) || '.50 EUR' WHEN 1 THEN 'no more than $' || n || '.25' WHEN 2 THEN 'not less than ' || n || ' PLN in Europe' WHEN 3 THEN 'under ' || n || 'k pounds'
    WHEN 4 THEN 'about ' || n ELSE 'at most ' || n || ' million crowns' END AS span,
    CAST(n AS DECIMAL(28, 6)) * CASE k WHEN 3 THEN 1000 WHEN 5 THEN 1000000 ELSE 1 END + CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0 END AS amount,
    CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'PLN' WHEN 3 THEN 'GBP' WHEN 5 THEN 'CZK' END AS currency, CASE k WHEN 0 THEN 'gt' WHEN 1 THEN 'le' WHEN 3 THEN 'lt' WHEN 5 THEN 'le' ELSE 'ge' END AS comparator, k = 4 AS tolerance
    FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderkey % 6 AS k FROM orders)""",
)
def _gr_money_parse(spark, sf):
    """Every order's price as a span in one of six wordings."""
    n, form = F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 6
    text_ = n.cast("string")
    wordings = (
        F.concat(F.lit("more than "), F.format_number(n, 0), F.lit(".50 EUR")),
        F.concat(F.lit("no more than $"), text_, F.lit(".25")),
        F.concat(F.lit("not less than "), text_, F.lit(" PLN in Europe")),
        F.concat(F.lit("under "), text_, F.lit("k pounds")),
        F.concat(F.lit("about "), text_),
        F.concat(F.lit("at most "), text_, F.lit(" million crowns")),
    )
    return grounding.read_money(table(spark, sf, "orders").select(F.coalesce(*[F.when(form == k, w) for k, w in enumerate(wordings)]).alias("span")))


@query(
    "gr_money_words",
    """SELECT span, CAST(a AS DECIMAL(28, 6)) AS amount, c AS currency, o AS comparator FROM (VALUES ('více než 1,5 milionu EUR', '1500000', 'EUR', 'gt'), ('2 mld Kč', '2000000000', 'CZK', 'ge'), ('pod 100 000 korun', '100000', 'CZK', 'lt'),
    ('půl milionu', '500000', NULL, 'ge'), ('ne více než 500', '500', NULL, 'le'), ('1.500,25 zł', '1500.25', 'PLN', 'ge'), ('nejméně sto tisíc', '100000', NULL, 'ge'), ('půl', NULL, NULL, NULL)) v(span, a, c, o)""",
)
def _gr_money_words(spark, sf):
    spans = ("více než 1,5 milionu EUR", "2 mld Kč", "pod 100 000 korun", "půl milionu", "ne více než 500", "1.500,25 zł", "nejméně sto tisíc", "půl")
    return grounding.read_money(spark.createDataFrame([(s,) for s in spans], "span string"), "cs").drop("tolerance")


query("gr_money_native", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey < 13")(
    lambda spark, sf: table(spark, sf, "supplier").filter(grounding.recognise_money("over 5,000").predicate(F.col("s_acctbal")) & (F.col("s_nationkey") < 13)).select("s_suppkey")
)
query("gr_money_fx", "SELECT o_orderkey FROM orders WHERE o_totalprice * 24.0 >= 5000000")(
    lambda spark, sf: grounding.fx_join(table(spark, sf, "orders"), _rates(spark), "o_totalprice", "EUR", "CZK", dt.date(2020, 1, 1)).filter(grounding.recognise_money("5 million").predicate(F.col("domestic"))).select("o_orderkey")
)
query("gr_geo_dist", f"SELECT c_custkey, round({_DISTANCE.format('50.0', '14.0')}, 3) AS metres FROM {_POINTS}")(
    lambda spark, sf: _points(spark, sf).select("c_custkey", F.round(grounding.geo_distance_m(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(14.0)), 3).alias("metres"))
)
_AREA = json.dumps({"type": "Polygon", "coordinates": [[[13.65000125, 49.15], [14.15, 49.15], [14.15, 49.85], [13.65000125, 49.15]]]})
query("gr_geo_bbox", f"SELECT c_custkey FROM {_POINTS} WHERE lat BETWEEN 49.15 AND 49.85 AND lon BETWEEN 13.65000125 AND 14.15")(
    lambda spark, sf: _points(spark, sf).filter(grounding.boundary(_AREA).in_box(F.col("lat"), F.col("lon"))).select("c_custkey")
)
query("gr_geo_boundary", "SELECT 'POLYGON ((13.65000125 49.15, 14.15 49.15, 14.15 49.85, 13.65000125 49.15))' AS wkt, 49.15::DOUBLE AS min_lat, 14.15::DOUBLE AS max_lon")(
    lambda spark, sf: (lambda b: spark.createDataFrame([(b.wkt, b.box[0], b.box[3])], "wkt string, min_lat double, max_lon double"))(grounding.boundary(_AREA))
)

# --- aggregation -------------------------------------------------------------------------------

_PRICE = Ref("o_totalprice")
plan_query(
    "agg_group",
    Aggregate(ORDERS, (Ref("o_orderstatus"), Ref("o_orderpriority")), (("count", None, False, "n"), ("min", _PRICE, False, "low"), ("max", _PRICE, False, "high"))),
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL",
)
plan_query("agg_global", Aggregate(ORDERS, (), (("count", None, False, "n"), ("max", _PRICE, False, "high"))), "SELECT count(*) AS n, max(o_totalprice) AS high FROM orders")
plan_query("agg_count", Aggregate(CUSTOMER, (Ref("c_mktsegment"),), (("count", Ref("c_acctbal"), False, "n"), ("count", None, False, "every"))), "SELECT c_mktsegment, count(c_acctbal) AS n, count(*) AS every FROM customer GROUP BY 1")
plan_query("agg_count_distinct", Aggregate(ORDERS, (Ref("o_orderstatus"),), (("count", Ref("o_custkey"), True, "buyers"), ("count_distinct", Ref("o_orderpriority"), False, "kinds"))), "SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1")
plan_query(
    "agg_sum",
    project(Aggregate(LINEITEM, (Ref("l_returnflag"),), (("sum", Ref("l_quantity"), False, "s"), ("mean", Ref("l_discount"), False, "a"), ("min", Ref("l_tax"), False, "lo"), ("max", Ref("l_tax"), False, "hi"))), flag="l_returnflag", qty=call("round", Ref("s"), 2), disc=call("round", Ref("a"), 6), lo="lo", hi="hi"),
    "SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1",
)
sql_query("agg_having", f"SELECT l_suppkey, count(*) AS n, {total('l_quantity', 'qty')} FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550 AND sum(l_quantity) > 100")
sql_query("agg_cond_distinct", "SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS buyers FROM orders GROUP BY o_orderpriority")
sql_query("agg_distinct_in_group", f"SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, {total('l_extendedprice', 'price')}, count(*) AS n FROM lineitem GROUP BY l_returnflag")
sql_query(
    "agg_ratio_guard",
    "SELECT l_suppkey, CAST(round(max(l_discount) * 100.0 / nullif(max(l_quantity), 0), 1) AS DECIMAL(18,1)) AS ratio FROM lineitem GROUP BY l_suppkey",
)
sql_query("agg_case_of_agg", "SELECT c_nationkey, CASE WHEN sum(c_acctbal) > 100000 THEN 'high' WHEN sum(c_acctbal) > 0 THEN 'some' ELSE 'none' END AS band FROM customer GROUP BY c_nationkey")
sql_query("agg_neg_sum", "SELECT s_nationkey, round(-sum(s_acctbal), 2) AS owed FROM supplier GROUP BY s_nationkey")
query("agg_dfdsl", "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")(
    lambda spark, sf: engine(spark, sf).run(
        json.dumps(
            {
                "ops": [
                    {"from": {"table": {"schemaCode": "db", "namespace": "main", "name": "orders"}}},
                    {"filter": {"op": "gt", "args": [{"col": "o_totalprice"}, {"value": 1000, "type": "float"}]}},
                    {"groupby": {"keys": ["o_orderstatus"], "aggregates": [{"function": "count", "alias": "n", "args": [{"name": "o_orderkey", "type": "unknown"}]}]}},
                ]
            }
        ),
        "dfdsl",
    )
)
sql_query("ext_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
sql_query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")

# --- windows, order, limits, sets --------------------------------------------------------------

sql_query("win_running_sum", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM orders")
plan_query(
    "win_over_ir",
    project(ORDERS, o_orderkey="o_orderkey", running=call("round", Over("sum", (_PRICE,), (Ref("o_custkey"),), ((Ref("o_orderdate"), False, True),)), 2)),
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM orders",
)
_BY = (Ref("o_custkey"),)
_THEN = ((Ref("o_orderdate"), False, True), (Ref("o_orderkey"), False, True))
plan_query(
    "win_rank",
    project(ORDERS, o_orderkey="o_orderkey", nth=Cast(Over("row_number", (), _BY, _THEN), "int"), place=Cast(Over("rank", (), _BY, _THEN[:1]), "int"), before=Over("lag", (Ref("o_orderkey"), Lit(1)), _BY, _THEN), moving=call("round", Over("sum", (_PRICE,), _BY, _THEN, (-1, 0)), 2)),
    """SELECT o_orderkey, row_number() OVER w AS nth, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS place, lag(o_orderkey) OVER w AS before,
    round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS moving
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)


def _placed(df: DataFrame) -> DataFrame:
    """A sorted result, written as it is, with each row's place, from the sizes of its partitions, so that the order can be compared."""
    mover, at = _mover(df.sparkSession), Location("blob", "sorted")
    mover.write(df.withColumn("__id", F.monotonically_increasing_id()), at)
    rows = mover.read(at).withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__id") - F.shiftleft("__part", 33)
    return rows.join(sizes, "__part").withColumn("place", F.col("__before") + inside).drop("__id", "__part", "__before")


_SORTED_NULLS = Sort(
    project(Join(NATION, Filter(SUPPLIER, call("gt", Ref("s_acctbal"), 9000.0)), "left", call("eq", Ref("n_nationkey"), Ref("s_nationkey"))), n_name="n_name", s_suppkey="s_suppkey"),
    ((Ref("s_suppkey"), True, True), (Ref("n_name"), False, False)),
)
query("sort_nulls", "SELECT n_name, s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC NULLS FIRST, n_name ASC NULLS LAST) - 1 AS place FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) s ON n_nationkey = s_nationkey")(
    lambda spark, sf: _placed(engine(spark, sf).run(json.dumps(frontends.to_wire(_SORTED_NULLS)), "relnode"))
)
query("sort_expr", "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey DESC) - 1 AS place FROM orders")(
    lambda spark, sf: _placed(engine(spark, sf).run("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, 1 DESC"))
)
plan_query("limit_offset", Limit(Sort(project(PART, p_partkey="p_partkey"), ((Ref("p_partkey"), False, False),)), 10, 7), "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 7")
sql_query("topk", "SELECT TOP 20 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
query("gov_topn", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 30")(
    lambda spark, sf: engine(spark, sf).run(json.dumps(frontends.to_wire(Limit(Sort(project(PART, p_partkey="p_partkey"), ((Ref("p_partkey"), False, False),)), 100))), "relnode", Options(top_n=30))
)
query("row_limit", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5")(lambda spark, sf: top_n(table(spark, sf, "supplier").select("s_suppkey").orderBy("s_suppkey"), 5))
plan_query("union_all", Union((project(NATION, name="n_name"), project(REGION, name="r_name"), project(NATION, name="n_name"))), "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
sql_query("union_hetero", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS amount FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 'p', p_partkey, p_retailprice FROM part")
sql_query("ext_set_ops", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")

# --- scalar functions --------------------------------------------------------------------------

plan_query(
    "fn_arithmetic",
    project(LINEITEM, k="l_orderkey", n="l_linenumber", a=call("round", call("add", Ref("l_quantity"), Ref("l_tax")), 4), b=call("subtract", Ref("l_linenumber"), 1), c=call("mul", Ref("l_linenumber"), 3), d=call("round", call("divide", Ref("l_linenumber"), 2), 4), e=call("modulo", call("negate", Ref("l_linenumber")), 3)),
    "SELECT l_orderkey AS k, l_linenumber AS n, round(l_quantity + l_tax, 4) AS a, l_linenumber - 1 AS b, l_linenumber * 3 AS c, round(l_linenumber / 2, 4) AS d, -l_linenumber % 3 AS e FROM lineitem",
)
plan_query("fn_add", project(PART, k="p_partkey", a=call("add", Ref("p_size"), Ref("p_partkey")), s=call("subtract", Ref("p_size"), Ref("p_partkey"))), "SELECT p_partkey AS k, p_size + p_partkey AS a, p_size - p_partkey AS s FROM part")
plan_query("fn_negate", project(SUPPLIER, k="s_suppkey", n=call("negate", Ref("s_acctbal"))), "SELECT s_suppkey AS k, -s_acctbal AS n FROM supplier")
plan_query("fn_mul", project(ORDERS, k="o_orderkey", m=call("mul", Ref("o_custkey"), 7)), "SELECT o_orderkey AS k, o_custkey * 7 AS m FROM orders")
plan_query(
    "fn_cmp",
    project(Filter(PART, call("or", call("and", call("ge", Ref("p_size"), 10), call("le", Ref("p_size"), 12), call("ne", Ref("p_size"), 11)), call("eq", Ref("p_size"), 40), call("lt", Ref("p_retailprice"), 905.0))), p_partkey="p_partkey"),
    "SELECT p_partkey FROM part WHERE (p_size >= 10 AND p_size <= 12 AND p_size <> 11) OR p_size = 40 OR p_retailprice < 905",
)
plan_query("fn_and", project(Filter(CUSTOMER, call("and", call("gt", Ref("c_acctbal"), 0.0), call("or", call("eq", Ref("c_nationkey"), 3), call("eq", Ref("c_mktsegment"), "BUILDING")))), c_custkey="c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND (c_nationkey = 3 OR c_mktsegment = 'BUILDING')")
plan_query(
    "fn_not",
    project(Filter(Join(NATION, Filter(REGION, call("lt", Ref("r_regionkey"), 3)), "left", call("eq", Ref("n_regionkey"), Ref("r_regionkey"))), call("or", call("is_null", Ref("r_name")), call("not", call("is_not_null", Ref("r_name"))), call("between", Ref("n_nationkey"), 2, 4))), n_nationkey="n_nationkey"),
    "SELECT n_nationkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey WHERE r_name IS NULL OR n_nationkey BETWEEN 2 AND 4",
)
_ODD_ORDERS = Join(CUSTOMER, Filter(ORDERS, call("eq", Ref("o_orderstatus"), "P")), "left", call("eq", Ref("c_custkey"), Ref("o_custkey")))
plan_query("fn_is_null", project(_ODD_ORDERS, c_custkey="c_custkey", none=call("is_null", Ref("o_orderkey")), some=call("is_not_null", Ref("o_orderkey"))), "SELECT c_custkey, o_orderkey IS NULL AS none, o_orderkey IS NOT NULL AS some FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
plan_query("fn_between", project(Filter(LINEITEM, call("between", Ref("l_quantity"), 10.0, 12.0)), l_orderkey="l_orderkey", l_linenumber="l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
plan_query("fn_in", project(Filter(CUSTOMER, call("in", Ref("c_mktsegment"), "BUILDING", "MACHINERY")), c_custkey="c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
plan_query(
    "fn_text",
    project(NATION, k="n_nationkey", up=call("upper", Ref("n_name")), low=call("lower", Ref("n_name")), both=call("concat", Ref("n_name"), "-", Cast(Ref("n_regionkey"), "text")), some=call("coalesce", Lit(None, "text"), Ref("n_name")), part=call("substring", Ref("n_name"), 2, 3)),
    "SELECT n_nationkey AS k, upper(n_name) AS up, lower(n_name) AS low, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS both, n_name AS some, substring(n_name, 2, 3) AS part FROM nation",
)
plan_query("fn_coalesce", project(_ODD_ORDERS, c_custkey="c_custkey", k=call("coalesce", Ref("o_orderkey"), Ref("c_custkey"))), "SELECT c_custkey, coalesce(o_orderkey, c_custkey) AS k FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
plan_query("fn_concat", project(PART, p=call("concat", Ref("p_brand"), "/", Ref("p_name"))), "SELECT p_brand || '/' || p_name AS p FROM part")
plan_query("fn_lower", project(CUSTOMER, k="c_custkey", low=call("lower", Ref("c_mktsegment")), up=call("upper", Ref("c_name"))), "SELECT c_custkey AS k, lower(c_mktsegment) AS low, upper(c_name) AS up FROM customer")
plan_query("fn_substring", project(PART, k="p_partkey", part=call("substring", Ref("p_name"), 3, 4)), "SELECT p_partkey AS k, substring(p_name, 3, 4) AS part FROM part")
plan_query("fn_like", project(Filter(PART, call("like", Ref("p_name"), "%e%_a%")), p_partkey="p_partkey"), "SELECT p_partkey FROM part WHERE p_name LIKE '%e%_a%'")
plan_query("fn_cast", project(ORDERS, k="o_orderkey", t=Cast(Ref("o_orderkey"), "text"), f=Cast(Ref("o_custkey"), "float"), i=Cast(Cast(Ref("o_orderkey"), "text"), "int"), b=Cast(Lit("true"), "bool")), "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_custkey AS DOUBLE) AS f, o_orderkey AS i, TRUE AS b FROM orders")
plan_query("fn_literal", project(Filter(REGION, call("ge", Ref("r_regionkey"), Param("least"))), r_name="r_name", one=Lit(1, "int"), none=Lit(None, "text")), "SELECT r_name, 1::BIGINT AS one, NULL::VARCHAR AS none FROM region WHERE r_regionkey >= 2", {"least": 2})
sql_query("fn_case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS simple FROM part")
sql_query("fn_isnull2", "SELECT n_name, ISNULL(r_name, 'none') AS r FROM nation WITH(NOLOCK) LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2", "SELECT n_name, coalesce(r_name, 'none') AS r FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2")
sql_query("fn_nullif", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS d FROM lineitem")
sql_query("fn_round", "SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a FROM customer")
query("fn_concat_sql", "SELECT n_nationkey, '%' || coalesce(CASE WHEN n_regionkey > 2 THEN n_name END, '') || '%' AS p FROM nation")(
    lambda spark, sf: table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("%"), F.coalesce(F.when(F.col("n_regionkey") > 2, F.col("n_name")), F.lit("")), F.lit("%")).alias("p"))
)
sql_query("fn_collate_like", "SELECT p_partkey FROM part WHERE p_name COLLATE Latin1_General_CI_AI LIKE CONCAT('%', {word}, '%')", "SELECT p_partkey FROM part WHERE contains(lower(strip_accents(p_name)), 'late')", {"word": "LÁTE"})
sql_query("fn_convert_style", "SELECT o_orderkey, CONVERT(varchar(10), o_orderdate, 104) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS d FROM orders")
sql_query("fn_dateadd", "SELECT o_orderkey, DATEADD(DAY, -120, CAST(o_orderdate AS date)) AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 120 DAY AS DATE) AS d FROM orders")
sql_query("fn_concat_pipes", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS STRING) AS p FROM nation", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR) AS p FROM nation")
sql_query(
    "fn_warmup_set",
    "SELECT substring(c_name, 1, 9) || '!' AS n, min(-o_totalprice) AS lo, round(sum(CAST(CAST(o_custkey AS STRING) AS DOUBLE)), 1) AS s FROM customer INNER JOIN orders ON c_custkey = o_custkey WHERE c_name LIKE 'C%' GROUP BY substring(c_name, 1, 9) ORDER BY s DESC, n LIMIT 9 OFFSET 0",
    "SELECT substring(c_name, 1, 9) || '!' AS n, min(-o_totalprice) AS lo, round(sum(CAST(CAST(o_custkey AS VARCHAR) AS DOUBLE)), 1) AS s FROM customer INNER JOIN orders ON c_custkey = o_custkey WHERE c_name LIKE 'C%' GROUP BY substring(c_name, 1, 9) ORDER BY s DESC, n LIMIT 9",
)
sql_query("fn_not_in_list", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (2, 10)")

# --- governance --------------------------------------------------------------------------------

_CZ = User("t7:ann", ("reader",), {"nation": 7, "segments": ["BUILDING", "MACHINERY"]})
_ROWS = Policy("nation", Match("exact", "customer"), Eq("c_nationkey", Attribute("nation")))
_SEGMENT = Policy("segment", Match("exact", "customer"), In("c_mktsegment", Attribute("segments")))


def _governed(name: str, oracle: str, policies: list[Policy], sql: str | None = None, plan: ir.Node | None = None, user: User = _CZ, options: Options | None = None) -> None:
    body, language = (sql, "sql") if sql else (json.dumps(frontends.to_wire(plan)), "relnode")
    query(name, oracle)(lambda spark, sf: engine(spark, sf, policies, user).run(body, language, options or Options()))


_governed("gov_rls", "SELECT c_custkey FROM customer WHERE c_nationkey = 7", [_ROWS], "SELECT c_custkey FROM customer")
_governed("rls_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", [_SEGMENT], plan=project(CUSTOMER, c_custkey="c_custkey"))
_governed("rls_and", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment IN ('BUILDING', 'MACHINERY')", [_ROWS, _SEGMENT], "SELECT c_custkey FROM customer")
_governed("rls_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)", [_ROWS], "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
_governed(
    "gov_pred",
    "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR NOT (c_mktsegment = 'BUILDING')) AND c_acctbal IS NOT NULL AND c_nationkey IN (1, 2, 3)",
    [Policy("p", Match("namespace", "main"), And((Or((Eq("c_nationkey", 3), Not(Eq("c_mktsegment", "BUILDING")))), In("c_nationkey", (1, 2, 3)))))],
    "SELECT c_custkey FROM customer",
)
_governed("gov_match", "SELECT count(*) AS n FROM nation", [_ROWS], "SELECT count(*) AS n FROM nation")
_governed("gov_identity", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", [Policy("t", Match("exact", "customer"), Eq("c_mktsegment", Attribute("tenant_id")))], "SELECT c_custkey FROM customer", user=User("BUILDING:bob", attributes={"tenant_id": "MACHINERY"}))
_governed("gov_deny", "SELECT c_custkey, c_name FROM customer", [Policy("d", Match("exact", "customer"), deny=("c_acctbal",))], "SELECT c_custkey, c_name FROM customer")
_governed("gov_mask", "SELECT c_custkey, 'hidden' AS c_name FROM customer", [Policy("m", Match("exact", "customer"), mask={"c_name": "hidden"})], "SELECT c_custkey, c_name FROM customer")
_governed("gov_admin", "SELECT c_custkey FROM customer", [_ROWS], "SELECT c_custkey FROM customer", user=User("t7:root", ("admin",)), options=Options(apply_security=False))
_governed("gov_strict", "SELECT c_custkey FROM customer WHERE c_nationkey = 3", [], plan=project(Filter(CUSTOMER, call("eq", Ref("c_nationkey"), 3)), c_custkey="c_custkey"), options=Options(strict=True))
query("gov_used", "SELECT * FROM (VALUES ('customer'), ('orders')) v(object)")(
    lambda spark, sf: spark.createDataFrame([(x,) for x in engine(spark, sf).compile("SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey").used], "object string")
)
query("gov_detect", "SELECT * FROM (VALUES ('CONFIRMED_DB', 'customer'), ('CONFIRMED_ER', 'Client'), ('MIXED', 'Client nation'), ('UNKNOWN', 'custmer')) v(verdict, names)")(
    lambda spark, sf: spark.createDataFrame([(parquet_catalog(sf).detect(names.split())[0], names) for names in ("customer", "Client", "Client nation", "custmer")], "verdict string, names string")
)


@query("gov_fp", "SELECT * FROM (VALUES ('list', 'dd0477e9e1e4dce741c42962e48f4c45ec905af077896691e7eb0d39ab0b5b24'), ('map', '7b37f63fa61f3d963e85608bba3034981898c1fc9f4d7b707d13490b1e7f91a3')) v(name, digest)")
def _gov_fp(spark, sf):
    schemas = {"list": "id bigint not null, tags array<bigint>", "map": "id bigint not null, attrs map<string,int>"}
    return spark.createDataFrame([(name, of_frame(spark.createDataFrame([], schema))) for name, schema in schemas.items()], "name string, digest string")


# --- text and fuzzy matching -------------------------------------------------------------------

_PHRASES = "(VALUES ('Žluťoučký  Kůň'), ('ÉTÉ '), ('plain')) v(s)"


def _phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Žluťoučký  Kůň",), ("ÉTÉ ",), ("plain",)], "s string")


query("tx_fold", f"SELECT s, lower(strip_accents(s)) AS folded FROM {_PHRASES}")(lambda spark, sf: _phrases(spark).select("s", text.tx_fold(F.col("s")).alias("folded")))
query("tx_canonical", f"SELECT s, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS canon FROM {_PHRASES}")(lambda spark, sf: _phrases(spark).select("s", text.tx_canonical(F.col("s")).alias("canon")))
query("tx_tokenize", f"SELECT unnest(regexp_extract_all(lower(strip_accents(s)), '\\S+')) AS token FROM {_PHRASES}")(lambda spark, sf: _phrases(spark).select(F.explode(text.tx_tokenize(F.col("s"))).alias("token")))
_PAIRS = "(SELECT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (table(spark, sf, "part").select(F.col("p_partkey").alias(f"k{x}"), F.col("p_name").alias(x)) for x in "ab")
    return a.join(b, F.col("kb") == F.col("ka") + 1).select("a", "b")


query("fz_lev_sim", f"SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 9) AS sim FROM {_PAIRS}")(lambda spark, sf: _pairs(spark, sf).select("a", "b", F.round(fuzzy.similarity("levenshtein", F.col("a"), F.col("b")), 9).alias("sim")))
query("fz_jaro", f"SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS sim FROM {_PAIRS}")(lambda spark, sf: _pairs(spark, sf).select("a", "b", F.round(fuzzy.similarity("jaro_winkler", F.col("a"), F.col("b")), 6).alias("sim")))
query("fz_damerau", "SELECT a, b, round(1 - d / greatest(length(a), length(b)), 9) AS sim FROM (VALUES ('paver', 'pavre', 1.0), ('abcd', 'abdc', 1.0), ('kitten', 'sitting', 3.0), ('x', 'x', 0.0)) v(a, b, d)")(
    lambda spark, sf: spark.createDataFrame([("paver", "pavre"), ("abcd", "abdc"), ("kitten", "sitting"), ("x", "x")], "a string, b string").select("a", "b", F.round(fuzzy.similarity("damerau", F.col("a"), F.col("b")), 9).alias("sim"))
)


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return readers.vocabulary(table(spark, sf, "part"), "p_partkey", "p_name", "part")


_TOKENS = "(SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS value, regexp_extract_all(lower(strip_accents(p_name)), '\\S+') AS tokens FROM part)"
query("fz_idf", f"SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1, 9) AS idf FROM (SELECT DISTINCT id, unnest(tokens) AS token FROM {_TOKENS}) GROUP BY token")(
    lambda spark, sf: fuzzy.idf(fuzzy.prepared(_members(spark, sf))).select("token", "df", F.round("idf", 9).alias("idf"))
)
query(
    "fz_seed",
    f"""WITH m AS {_TOKENS}, p AS (SELECT id, value, unnest(tokens) AS token FROM m), q AS (SELECT DISTINCT value AS span, unnest(list_distinct(list_transform(tokens, lambda t, i: CASE WHEN i = 1 THEN 'x' || t ELSE t END))) AS t FROM m WHERE len(tokens) > 1),
    sure AS (SELECT DISTINCT span, token FROM q JOIN p ON t = token), lost AS (SELECT * FROM q WHERE span NOT IN (SELECT span FROM sure)),
    every AS (SELECT * FROM sure UNION SELECT span, token FROM lost JOIN (SELECT DISTINCT token FROM p) ON levenshtein(t, token) <= 2) SELECT DISTINCT span, id, value FROM every JOIN p USING (token)""",
)(
    lambda spark, sf: (lambda members: fuzzy.seeds(members.filter("value LIKE '% %'").select(F.col("value").alias("span_id"), F.concat(F.lit("x"), F.col("value")).alias("span")).distinct(), members).select(F.col("span_id").alias("span"), "id", "value"))(_members(spark, sf))
)
query("fz_resolve", f"SELECT q.t AS query_token, v.t AS token, levenshtein(q.t, v.t) AS distance FROM (SELECT DISTINCT unnest(tokens) AS t FROM {_TOKENS}) q JOIN (SELECT DISTINCT unnest(tokens) AS t FROM {_TOKENS}) v ON levenshtein(q.t, v.t) <= 2")(
    lambda spark, sf: (lambda rows: fuzzy.resolve(rows.select(F.explode("tokens").alias("query_token")), fuzzy.idf(rows)).withColumn("distance", F.col("distance").cast("long")))(fuzzy.prepared(_members(spark, sf)))
)



_LOST = "left(p_name, 3) || substring(p_name, 5)"


def _fuzzy_sql(limit: int, category: str = "'part'", where: str = "TRUE", by: str = "") -> str:
    """Matching in SQL up to the retrieved rows: every list of tokens against every other one."""
    return f"""WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS value, {category} AS category, regexp_extract_all(lower(strip_accents(p_name)), '\\S+') AS tokens FROM part WHERE {where}),
    n AS (SELECT count(*) AS total FROM m), v AS (SELECT token, ln((any_value(total) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT DISTINCT id, category, unnest(tokens) AS token FROM m), n GROUP BY token),
    q AS (SELECT p_partkey AS span_id, regexp_extract_all(lower(strip_accents({_LOST})), '\\S+') AS qt FROM part),
    asked AS (SELECT qt, unnest(qt) AS t, unnest(range(1, len(qt) + 1)) AS place FROM (SELECT DISTINCT qt FROM q)), held AS (SELECT DISTINCT tokens, unnest(tokens) AS token FROM (SELECT DISTINCT tokens FROM m)),
    best AS (SELECT qt, place, tokens, 1 - levenshtein(t, token) / greatest(length(t), length(token)) AS good, idf FROM asked JOIN held ON levenshtein(t, token) <= 2 JOIN v USING (token)
      QUALIFY row_number() OVER (PARTITION BY qt, place, tokens ORDER BY levenshtein(t, token), token) = 1),
    pairs AS (SELECT a.qt, tokens, count(*) AS p FROM asked a JOIN asked b ON a.qt = b.qt AND a.place < b.place CROSS JOIN (SELECT DISTINCT tokens FROM m)
      WHERE list_position(tokens, a.t) > 0 AND list_position(tokens, b.t) > list_position(tokens, a.t) GROUP BY ALL),
    base AS (SELECT qt, tokens, round(sum(good * idf) / (sum(idf) + (len(qt) - count(*)) * (ln(any_value(total) + 1) + 1)), 12) AS base FROM best, n GROUP BY qt, tokens),
    found AS (SELECT qt, tokens, id, category, value, base, least(pow(1.1, coalesce(p, 0)), 1.5) AS bonus FROM base JOIN m USING (tokens) LEFT JOIN pairs USING (qt, tokens)
      QUALIFY row_number() OVER (PARTITION BY qt{by} ORDER BY base DESC, id, category, value) <= {max(500, 4 * limit)}),
    ranked AS (SELECT *, round(base * bonus, 9) AS score, row_number() OVER (PARTITION BY qt{by} ORDER BY round(base * bonus, 9) DESC, id, category) AS nth FROM found)
    """


def _lost_letter(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name without its fourth letter."""
    return table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("span_id"), F.expr("concat(left(p_name, 3), substring(p_name, 5))").alias("span"))


@query("fz_score", _fuzzy_sql(5) + "SELECT span_id, id, category, value, score, nth FROM q JOIN ranked USING (qt) WHERE nth <= 5")
def _fz_score(spark, sf):
    """The best five members for spans with a letter lost, many spans in one join."""
    return fuzzy.match(_lost_letter(spark, sf), _members(spark, sf), 5)


@query("fz_retrieve", _fuzzy_sql(150) + "SELECT array_to_string(qt, ' ') AS span, id, value, base FROM found")
def _fz_retrieve(spark, sf):
    """The 600 candidates that are scored exactly for each distinct span."""
    found = fuzzy.retrieve(_lost_letter(spark, sf), _members(spark, sf), 150)
    return found.select(F.array_join("query_tokens", " ").alias("span"), "id", "value", "base")


query("fz_topk", "SELECT span_id, id, category, score, nth FROM (SELECT s_nationkey AS span_id, CAST(s_suppkey AS VARCHAR) AS id, 'supplier' AS category, floor(s_acctbal / 1000) AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC, CAST(s_suppkey AS VARCHAR)) AS nth FROM supplier) WHERE nth <= 7")(
    lambda spark, sf: fuzzy.top(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("span_id"), F.col("s_suppkey").cast("string").alias("id"), F.lit("supplier").alias("category"), F.floor(F.col("s_acctbal") / 1000).cast("double").alias("score")), 7)
)
_BRANDS = ("Brand#2", "Brand#3", "Brand#17")


@query("fz_batch", _fuzzy_sql(2, "p_brand", f"p_brand IN {_BRANDS}", ", category") + "SELECT span_id, id, category, score, nth FROM q JOIN ranked USING (qt) WHERE nth <= 2")
def _fz_batch(spark, sf):
    """Every span against three categories at once, two members of each."""
    members = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("value"), F.col("p_brand").alias("category"))
    return fuzzy.batch(_lost_letter(spark, sf), members, list(_BRANDS), 2).select("span_id", "id", "category", "score", "nth")


query("fz_legacy_score", "SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE), (2, 0.9375), (3, 0.5), (4, 1.1)) v(id, score)")(
    lambda spark, sf: spark.createDataFrame(
        [(1, ["ab"], ["ab"]), (2, ["red", "stone"], ["stone", "rod"]), (3, ["abcde"], ["vwxyz"]), (4, ["a", "b"], ["a", "b"])], "id long, q array<string>, c array<string>"
    ).select("id", F.round(fuzzy.legacy_score(F.col("q"), F.col("c")), 9).alias("score"))
)
query("fz_levenshtein_topk", "SELECT p_partkey, d FROM (SELECT p_partkey, levenshtein(p_name, (SELECT p_name FROM part WHERE p_partkey = 3)) AS d FROM part) ORDER BY d, p_partkey LIMIT 15")(
    lambda spark, sf: (lambda p: p.select("p_partkey", F.levenshtein("p_name", p.filter("p_partkey = 3").select("p_name").scalar()).cast("long").alias("d")).orderBy("d", "p_partkey").limit(15))(table(spark, sf, "part"))
)


def _scored(spark: SparkSession) -> DataFrame:
    rows = [(1, "a", "T1", 0.9, False), (1, "b", "T2", 0.7, False), (1, "c", "T1", 0.6, False), (2, "a", "T1", 0.4, False), (2, "d", "T3", 0.4, True), (3, "e", "T2", 0.95, False)]
    return spark.createDataFrame(rows, "span_id long, id string, target string, score double, off boolean")


query("fz_cascade", "SELECT * FROM (VALUES (1::BIGINT, 'a', 0), (1, 'b', 0), (1, 'c', 0), (2, 'z', 1), (3, 'e', 0)) v(span_id, id, step)")(
    lambda spark, sf: fuzzy.cascade([(_scored(spark).select("span_id", "id", "score"), 0.5), (spark.createDataFrame([(2, "z", 0.1), (1, "y", 1.0)], "span_id long, id string, score double"), 0.9)]).select("span_id", "id", "step")
)
query("fz_lookup", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS value FROM part WHERE lower(p_name) LIKE 'b%' ORDER BY p_name, CAST(p_partkey AS VARCHAR) LIMIT 200")(lambda spark, sf: fuzzy.lookup(_members(spark, sf), ["part", "none"], "b")[0].select("id", "value"))
query("fz_method", f"SELECT count(*) FILTER (WHERE levenshtein(a, b) <= 6) AS typos, count(*) FILTER (WHERE a = b) AS exact FROM {_PAIRS}")(
    lambda spark, sf: _pairs(spark, sf).agg(F.count_if(fuzzy.admitted(F.col("a"), F.col("b"), "typos", 6)).alias("typos"), F.count_if(fuzzy.admitted(F.col("a"), F.col("b"), "exact")).alias("exact"))
)
query("fz_profile", "SELECT * FROM (VALUES ('Praha', 'praha', 1.0::DOUBLE), ('Prah', 'praha', 0.8), ('Zlín', 'zlin', 0.95)) v(span, value, score)")(
    lambda spark, sf: fuzzy.profile_score(
        spark.createDataFrame([("Praha", "praha", 0.1), ("Prah", "praha", 0.1), ("Zlín", "zlin", 0.1), ("ab", "abc", 0.1), ("Brno", "praha", 0.1)], "span string, value string, score double"),
        [fuzzy.Rule("canonical", exact=1.0, typos=(1, 0.2)), fuzzy.Rule("folded", exact=0.95)],
    )
)
query("fz_margin", "SELECT * FROM (VALUES (1::BIGINT, 'a', 0.2::DOUBLE), (1, 'b', -0.2), (1, 'c', 0.2), (2, 'a', 0.4), (2, 'd', 0.0), (3, 'e', 0.95)) v(span_id, id, margin)")(lambda spark, sf: fuzzy.with_margin(_scored(spark), suppressed="off").select("span_id", "id", F.round("margin", 6).alias("margin")))
query("fz_overlay", "SELECT * FROM (VALUES ('x', 'a', TRUE), ('x', 'b', FALSE)) v(span, id, negative)")(
    lambda spark, sf: fuzzy.with_overlay(spark.createDataFrame([("x", "a"), ("x", "b")], "span string, id string"), spark.createDataFrame([("x", "a"), ("y", "b")], "span string, id string"))
)
query("fz_axes", "SELECT * FROM (VALUES (1::BIGINT, 0.9::DOUBLE), (2, 0.5)) v(id, score)")(
    lambda spark, sf: spark.createDataFrame([(1, 0.3, 0.9), (2, 0.5, None)], "id long, surface double, lemma double").select("id", F.greatest("surface", "lemma").alias("score"))
)

# --- annotation --------------------------------------------------------------------------------

_TEXTS = [(1, "Acme Corp paid John Smith 500 EUR."), (2, "John met Acme."), (3, "")]


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TEXTS, "doc_id long, text string")


_LIST = [("Acme", "Org", "company"), ("Acme Corp", "Org", "company"), ("John Smith", "Person", "name"), ("John", "Person", "name")]


@query("nl_ops", r"SELECT doc_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]'))) AS BIGINT) AS tokens FROM documents GROUP BY doc_id")
def _nl_ops(spark, sf):
    """Tokens of every document, 0 for those without any."""
    docs = table(spark, sf, "documents")
    found = annotate.tokenise(docs).select("doc_id", F.lit(1).alias("n"))
    return found.unionAll(docs.select(F.col("doc_id").cast("long"), F.lit(0))).groupBy("doc_id").agg(F.sum("n").alias("tokens"))


query("nl_sentences", r"SELECT doc_id, unnest(s) AS sentence, CAST(unnest(range(len(s))) AS BIGINT) AS nth FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)")(
    lambda spark, sf: annotate.sentences(table(spark, sf, "documents")).select("doc_id", F.col("nth").cast("long").alias("nth"), "sentence")
)
query("nl_doc", "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (2, 0)) v(doc_id, dropped)")(
    lambda spark, sf: annotate.import_annotations(spark.createDataFrame([(1, "A", 0, 2, {}), (1, "A", 0, 2, {}), (2, "A", 0, 2, {})], annotate.SCHEMA))[1]
)
query("nl_gaz", "SELECT * FROM (VALUES (1::BIGINT, 'Org', 0::BIGINT, 9::BIGINT), (1, 'Person', 15, 25), (2, 'Person', 0, 4), (2, 'Org', 9, 13)) v(doc_id, type, first, after)")(
    lambda spark, sf: annotate.gazetteer(_texts(spark), _LIST).select("doc_id", "type", F.col("start").alias("first"), F.col("end").alias("after"))
)


def _paid_rules() -> tuple[annotate.Rule, ...]:
    who = annotate.Step(ann="Person", bind="who")
    anything = annotate.Step(ann="Token", least=0, most=3)
    org = annotate.Step(ann="Org", bind="org")
    return (
        annotate.Rule("met", (who, anything, org), (("add", "Meeting", None, {"who": ("who", "@string")}),)),
        annotate.Rule("org", (org,), (("add", "Company", "org", {"size": ("org", "@length"), "kind": ("org", "category")}),), priority=1),
    )


@query("nl_rule", "SELECT * FROM (VALUES (1::BIGINT, 'Company', '9', NULL), (2, 'Meeting', NULL, 'John')) v(doc_id, type, size, who)")
def _nl_rule(spark, sf):
    docs = _texts(spark)
    anns = annotate.gazetteer(docs, _LIST).unionAll(annotate.tokenise(docs))
    out = annotate.apply_rules(docs, anns, _paid_rules(), "appelt")
    return out.filter(F.col("type").isin("Meeting", "Company")).select("doc_id", "type", F.col("features")["size"].alias("size"), F.col("features")["who"].alias("who"))


def _fired(spark: SparkSession, rules: tuple[annotate.Rule, ...], control: str, *kinds: str) -> DataFrame:
    docs = _texts(spark)
    anns = annotate.gazetteer(docs, _LIST).unionAll(annotate.tokenise(docs))
    return annotate.apply_rules(docs, anns, rules, control).filter(F.col("type").isin(*kinds))


query("nl_constraint", "SELECT * FROM (VALUES (1::BIGINT, 30::BIGINT, 33::BIGINT)) v(doc_id, first, after)")(
    lambda spark, sf: _fired(spark, (annotate.Rule("n", (annotate.Step(ann="Token", where={"string": {"regex": "^[A-Z]{3}$"}}, bind="w"),), (("add", "Code", "w", {}),)),), "all", "Code").select("doc_id", F.col("start").alias("first"), F.col("end").alias("after"))
)


def _two_names(control: str):
    name = annotate.Step(ann="Person", bind="p")
    more = annotate.Step(ann="Token", least=1, most=2, bind="t")
    return lambda spark: _fired(spark, (annotate.Rule("name", (name,), (("add", "Hit", None, {"control": control}),)), annotate.Rule("name and more", (name, more), (("add", "Hit", None, {"control": control}),))), control, "Hit")


query("nl_control", "SELECT * FROM (VALUES ('appelt', 2::BIGINT), ('brill', 4), ('once', 2), ('first', 2)) v(control, n)")(
    lambda spark, sf: reduce(DataFrame.unionAll, [_two_names(c)(spark).groupBy(F.col("features")["control"].alias("control")).agg(F.count(F.lit(1)).alias("n")) for c in ("appelt", "brill", "once", "first")])
)
query("nl_action", "SELECT * FROM (VALUES (1::BIGINT, 'Firm', '9'), (2, 'Firm', '4')) v(doc_id, type, size)")(
    lambda spark, sf: _fired(spark, (annotate.Rule("org", (annotate.Step(ann="Org", bind="o"),), (("add", "Firm", "o", {"size": ("o", "@length")}),)),), "appelt", "Firm").select("doc_id", "type", F.col("features")["size"].alias("size"))
)


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("kočky", "kočka", "N", 2.0), ("kočky", "kočko", "X", 1.0), ("psů", "pes", "N", 1.0)], "surface string, lemma string, pos string, weight double")


def _forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("kočky",), ("kocky",), ("psů",), ("walking",), ("xyz",), ("learnt",)], "word string")


query("nl_morph_lookup", "SELECT * FROM (VALUES ('kočky', 'kočka', 'exact'), ('kocky', 'kočka', 'folded'), ('psů', 'pes', 'exact'), ('walking', NULL, 'none'), ('xyz', NULL, 'none'), ('learnt', NULL, 'none')) v(word, lemma, via)")(
    lambda spark, sf: annotate.morph_lookup(_forms(spark), _lexicon(spark)).select("word", "lemma", "via")
)
query("nl_morph_chain", "SELECT * FROM (VALUES ('kočky', 'kočka', 'exact'), ('kocky', 'kočka', 'folded'), ('psů', 'pes', 'exact'), ('walking', 'walk', 'guess'), ('xyz', 'xyz', 'guess'), ('learnt', 'learn', 'statistical')) v(word, lemma, via)")(
    lambda spark, sf: annotate.morph_chain(_forms(spark), _lexicon(spark), spark.createDataFrame([("learnt", "learn")], "word string, lemma string"), ("ing", "g", "yz")).select("word", "lemma", "via")
)
query("nl_morph_gen", "SELECT * FROM (VALUES ('žena', 'žena', 'nom'), ('žena', 'ženy', 'gen')) v(lemma, form, tag)")(
    lambda spark, sf: annotate.morph_generate(spark.createDataFrame([("žena", "žen", "f")], "lemma string, stem string, paradigm string"), spark.createDataFrame([("f", "a", "nom"), ("f", "y", "gen"), ("m", "u", "gen")], "paradigm string, ending string, tag string"))
)
query("nl_metrics", "SELECT * FROM (VALUES ('N', 3::BIGINT, 0.666667::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE)) v(pos, n, coverage, lemma_in_set, head)")(
    lambda spark, sf: annotate.morph_metrics(spark.createDataFrame([("N", "a", ["a"], ["a"]), ("N", "b", ["c", "b"], ["c", "b", "d"]), ("N", "x", [], [])], "pos string, gold string, lemmas array<string>, folded_lemmas array<string>")).select("pos", "n", F.round("coverage", 6).alias("coverage"), "lemma_in_set", "head")
)

# --- ranking, graph, evaluation ----------------------------------------------------------------

query("rk_binder", "SELECT * FROM (VALUES ('s1', 'A', 'bound', 'EXACT'), ('s2', NULL, 'tie', 'LEARNED'), ('s3', NULL, 'weak', 'WEAK')) v(span, bound, verdict, class)")(
    lambda spark, sf: rank.bind(spark.createDataFrame([("s1", "A", "EXACT", 0.1), ("s1", "B", "LEARNED", 0.9), ("s2", "A", "LEARNED", 0.5), ("s2", "B", "LEARNED", 0.5), ("s3", "C", "WEAK", 1.0)], "span string, target string, class string, score double"))
)
query("md_list", "SELECT * FROM (VALUES ('table', 'lineitem'), ('table', 'nation')) v(kind, name)")(lambda spark, sf: spark.createDataFrame(parquet_catalog(sf).listing("table", offset=7, limit=2), "kind string, name string"))
query("md_search", "SELECT * FROM (VALUES ('custmer', 'table', 'customer'), ('natoin', 'table', 'nation'), ('open orders of 2000', 'query', 'open_orders'), ('zzz', NULL, NULL)) v(asked, kind, found)")(
    lambda spark, sf: spark.createDataFrame([(asked, *((hits[0].kind, hits[0].name) if hits else (None, None))) for asked in ("custmer", "natoin", "open orders of 2000", "zzz") for hits in [parquet_catalog(sf).search(asked)]], "asked string, kind string, found string")
)
query(
    "md_traverse",
    "WITH RECURSIVE e(src, dst) AS (VALUES ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier'), ('orders', 'customer'), ('customer', 'nation'), ('supplier', 'nation'), ('nation', 'region')), r(node, depth) AS (SELECT 'lineitem', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 10) SELECT node, min(depth) AS depth FROM r GROUP BY node",
)(lambda spark, sf: engine(spark, sf).traverse("lineitem", ("references",)))
query("ev_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "events").groupBy("event_type").agg(*[rank.nearest_rank("value", p / 100).alias(f"p{p}") for p in (50, 95, 99)])
)
query("ds_scan_set", "SELECT * FROM (VALUES (0, 'customer'), (1, 'orders')) v(nth, name)")(
    lambda spark, sf: spark.createDataFrame(list(enumerate(ir.scan_set(Join(CUSTOMER, Filter(ORDERS, Sub("exists", CUSTOMER)))))), "nth int, name string")
)
query("fmt_json", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")(lambda spark, sf: formats.json_lines(table(spark, sf, "region")))

# --- the headline queries ----------------------------------------------------------------------

sql_query(
    "monthly_sales",
    f"SELECT CAST(month(o_orderdate) AS BIGINT) AS moy, {total('l_extendedprice', 'sales')}, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = {{year}} GROUP BY CAST(month(o_orderdate) AS BIGINT)",
    f"SELECT month(o_orderdate) AS moy, {total('l_extendedprice', 'sales')}, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 2000 GROUP BY 1",
    {"year": 2000},
)
sql_query("top_items_by_revenue", "SELECT p_partkey, p_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name ORDER BY revenue DESC, p_partkey LIMIT 100")
QUERIES["customer_running_total"], ORACLE["customer_running_total"] = QUERIES["win_running_sum"], ORACLE["win_running_sum"]
sql_query(
    "channel_revenue_cte",
    f"WITH sales AS (SELECT 'returned' AS channel, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'kept', l_extendedprice FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT 'accepted', l_extendedprice FROM lineitem WHERE l_returnflag = 'A') SELECT channel, {total('price', 'revenue')} FROM sales GROUP BY channel",
)
sql_query("having_ratio", "SELECT l_suppkey, round(sum(l_discount) * 100.0 / nullif(sum(l_quantity), 0), 4) AS share FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 1000")
query("ext_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")(
    lambda spark, sf: streams.windowed(table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
)


# --- moves and formats -------------------------------------------------------------------------


def _mover(spark: SparkSession) -> Mover:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise EngineError("no_shared_folder", "spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="moves-")
    return Mover(spark, f"{base.rstrip('/')}/moves-{uuid.uuid4().hex}", Workspace())


def _moved(verb: str, source: Location, target: Location):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        mover = _mover(spark)
        mover.write(table(spark, sf, "nation").select("n_nationkey", "n_name"), source)
        mover.move(verb, source, target, expect=of_frame(mover.read(source)))
        return mover.read(target)

    return run


_BLOB, _CACHED, _FRAME = Location("blob", "out/nations"), Location("cache", "nations"), Location("session_df", "nations", "s1")
for _key, _verb, _from, _to in (
    ("mv_materialize", "materialize", _FRAME, _BLOB),
    ("src_session_df", "materialize", _FRAME, _CACHED),
    ("mv_stage", "stage", _BLOB, _FRAME),
    ("mv_copy", "copy", _BLOB, _CACHED),
    ("src_cache", "stage", _CACHED, _FRAME),
):
    query(_key, "SELECT n_nationkey, n_name FROM nation")(_moved(_verb, _from, _to))

query("snk_arrow_stream", "SELECT * FROM (VALUES (0, 10), (1, 10), (2, 5)) v(nth, rows)")(
    lambda spark, sf: spark.createDataFrame([(k, b.num_rows) for k, b in enumerate(formats.arrow_batches(table(spark, sf, "nation"), 10))], "nth int, rows int")
)


query("worker_row_limit", "SELECT * FROM (VALUES (0, 10), (1, 10)) v(nth, rows)")(
    lambda spark, sf: spark.createDataFrame([(k, b.num_rows) for k, b in enumerate(formats.limited_batches(table(spark, sf, "nation"), 10, 12))], "nth int, rows int")
)


@query("mv_describe", "SELECT count(*) AS rows FROM nation")
def _mv_describe(spark, sf):
    mover = _mover(spark)
    mover.write(table(spark, sf, "nation"), _CACHED, ttl=60)
    return spark.createDataFrame([(mover.describe(_CACHED, count=True)["rows"],)], "rows long")


def _rendered(form: str):
    return lambda spark, sf: spark.createDataFrame([(formats.render(table(spark, sf, "region").orderBy("r_regionkey"), form)[0].decode(),)], "body string")


query("fmt_csv", "SELECT 'r_regionkey,r_name' || chr(13) || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(13) || chr(10), '' ORDER BY r_regionkey) AS body FROM region")(_rendered("csv"))
query("fmt_tsv", "SELECT 'r_regionkey' || chr(9) || 'r_name' || chr(10) || string_agg(r_regionkey || chr(9) || r_name || chr(10), '' ORDER BY r_regionkey) AS body FROM region")(_rendered("tsv"))
query("fmt_markdown", "SELECT '| r_regionkey | r_name |' || chr(10) || '| ---: | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |' || chr(10), '' ORDER BY r_regionkey) AS body FROM region")(_rendered("markdown"))
query("ml_fit", "SELECT event_type, round(regr_slope(value, user_id), 9) AS slope, round(regr_intercept(value, user_id), 6) AS intercept FROM events GROUP BY event_type")(
    lambda spark, sf: table(spark, sf, "events").groupBy("event_type").agg(F.round(F.regr_slope("value", "user_id"), 9).alias("slope"), F.round(F.regr_intercept("value", "user_id"), 6).alias("intercept"))
)


@query("src_jdbc_table", "SELECT n_nationkey, n_name FROM nation")
def _src_jdbc_table(spark, sf):
    """Through a database that every executor opens for itself."""
    url = packed_database(table(spark, sf, "nation").select(F.col("n_nationkey").alias("K"), F.col("n_name").alias("NAME")), "nations")
    return readers.jdbc_table(spark, url, "nations", partition=("K", 0, 25, 2), **DERBY).toDF("n_nationkey", "n_name")


@query("src_blob_ipc", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, NULL)) v(n, s)")
def _src_blob_ipc(spark, sf):
    body, rows = io.BytesIO(), pa.table({"n": [1, 2], "s": ["x", None]})
    with pa.ipc.new_stream(body, rows.schema) as out:
        out.write_table(rows)
    return readers.ipc_file(spark, _mover(spark).put_bytes("in/rows.arrow", body.getvalue()))


@query("snk_store", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0")
def _snk_store(spark, sf):
    plan = ir.Store("blob:kept", project(Filter(CUSTOMER, call("gt", Ref("c_acctbal"), 0.0)), c_custkey="c_custkey"), "create")
    mover = _mover(spark)
    engine(spark, sf, [_ROWS], _CZ).store(json.dumps(frontends.to_wire(plan)), "relnode", mover)
    return mover.read(Location("blob", "kept"))


@query("snk_drop", "SELECT * FROM (VALUES (TRUE, FALSE, 'b')) v(first, again, rest)")
def _snk_drop(spark, sf):
    space = Workspace()
    for name in "ab":
        space.put("s", name, spark.range(1))
    return spark.createDataFrame([(space.drop("s", "a"), space.drop("s", "a"), ",".join(space.names("s")))], "first boolean, again boolean, rest string")


def _code(act: Callable) -> str:
    try:
        act()
    except EngineError as e:
        return e.code
    return "ok"


@query("snk_db_create", "SELECT * FROM (VALUES ('create', 'ok'), ('create', 'target_exists'), ('append', 'ok'), ('append', 'schema_mismatch'), ('replace', 'ok')) v(mode, outcome)")
def _snk_db_create(spark, sf):
    """Write modes of a table, in the session's own catalog."""
    mover, name = _mover(spark), f"modes_{uuid.uuid4().hex[:8]}"
    rows = table(spark, sf, "region")
    tries = [("create", rows), ("create", rows), ("append", rows), ("append", rows.select("r_name")), ("replace", rows.limit(2))]
    out = [(mode, _code(lambda df=df, mode=mode: mover.write(df, Location("db_table", name), mode))) for mode, df in tries]
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(out, "mode string, outcome string")


@query("mv_evict", "SELECT * FROM (VALUES (TRUE, 'illegal_move')) v(gone, of_table)")
def _mv_evict(spark, sf):
    mover = _mover(spark)
    mover.write(table(spark, sf, "region"), _BLOB)
    return spark.createDataFrame([(mover.evict(_BLOB), _code(lambda: mover.evict(Location("db_table", "t"))))], "gone boolean, of_table string")


query("mv_noop", "SELECT FALSE AS moved")(lambda spark, sf: spark.createDataFrame([(_mover(spark).move("copy", _BLOB, _BLOB)["moved"],)], "moved boolean"))


@query("mv_pipe", "SELECT 'fingerprint_mismatch' AS code, count(*) AS rows FROM nation")
def _mv_pipe(spark, sf):
    """A move whose schema is not the one expected writes nothing."""
    mover = _mover(spark)
    mover.write(table(spark, sf, "region"), _BLOB)
    mover.write(table(spark, sf, "nation"), _CACHED)
    code = _code(lambda: mover.move("copy", _BLOB, _CACHED, expect="0" * 64))
    return spark.createDataFrame([(code, mover.read(_CACHED).count())], "code string, rows long")


query("fmt_parquet", "SELECT r_regionkey, r_name FROM region")(
    lambda spark, sf: spark.createDataFrame(pq.read_table(io.BytesIO(formats.render(table(spark, sf, "region"), "parquet")[0])))
)


def _sheet_cells(body: bytes) -> list[list[str]]:
    """Rows of an xlsx file's first sheet, numbers and inline texts as text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    sheet = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(body)).read("xl/worksheets/sheet1.xml"))
    return [["".join(x.text or "" for x in cell.iter() if x.tag in (f"{space}v", f"{space}t")) for cell in row.iter(f"{space}c")] for row in sheet.iter(f"{space}row")]


query("fmt_xlsx", "SELECT 'r_regionkey' AS one, 'r_name' AS two UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")(
    lambda spark, sf: spark.createDataFrame(_sheet_cells(formats.render(table(spark, sf, "region"), "xlsx")[0]), "one string, two string")
)
sql_query("fn_plus_string", "SELECT o_orderkey, 'on ' + CONVERT(varchar(10), o_orderdate, 104) AS d FROM orders", "SELECT o_orderkey, 'on ' || strftime(o_orderdate, '%d.%m.%Y') AS d FROM orders")
sql_query("fn_now", "SELECT CAST(GETDATE() AS date) = current_date() AS same", "SELECT TRUE AS same")


@query("gov_default_policy", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _gov_default_policy(spark, sf):
    rows = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "tenant_id")
    catalog = Catalog({"accounts": Table("accounts", lambda s: rows, "dbo")})
    return Engine(spark, catalog, [TENANT_ISOLATION], User("BUILDING:ann")).run("SELECT c_custkey FROM accounts")


def _refusals(spark: SparkSession, *cases: tuple[str, Callable]) -> DataFrame:
    return spark.createDataFrame([(name, _code(act)) for name, act in cases], "what string, code string")


query("gov_mixed", "SELECT * FROM (VALUES ('sql', 'validator_mixed_layer_tree'), ('plan', 'validator_mixed_layer_tree')) v(what, code)")(
    lambda spark, sf: _refusals(
        spark,
        ("sql", lambda: engine(spark, sf).run("SELECT 1 FROM Client, nation")),
        ("plan", lambda: engine(spark, sf).run(json.dumps(frontends.to_wire(Union((NATION, ir.EntityScan("Country"))))), "relnode")),
    )
)
query("gov_tenant_pg", "SELECT * FROM (VALUES ('no uuid', 'tenant_id_required')) v(what, code)")(
    lambda spark, sf: _refusals(spark, ("no uuid", lambda: readers.jdbc_table(spark, "jdbc:derby:memory:none", "t", tenant="nobody")))
)


@query("gov_skip_ws", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def _gov_skip_ws(spark, sf):
    """A frame was filtered when it was made; reading it applies no policy again."""
    space = Workspace()
    e = engine(spark, sf, [_ROWS], _CZ, space)
    space.put(_CZ.name, "mine", e.run("SELECT c_custkey FROM customer"))
    return e.run(json.dumps({"ops": [{"from": {"workspace": "mine"}}]}), "dfdsl")




@query("snk_workspace", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _snk_workspace(spark, sf):
    """A result kept as a session frame under a name, then replaced, and read back."""
    space = Workspace()
    e = engine(spark, sf, workspace=space)
    space.put(e.user.name, "sums", e.run("SELECT o_orderstatus FROM orders"))
    space.put(e.user.name, "sums", e.run("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"))
    return e.run(json.dumps({"ops": [{"from": {"workspace": "sums"}}]}), "dfdsl")


@query("gov_llm_guard", "SELECT * FROM (VALUES ('refused', 'llm_guard_refused'), ('passed', 'ok')) v(what, code)")
def _gov_llm_guard(spark, sf):
    """The hook for a reviewer; none is built in."""

    def reviewer(compiled):
        if "orders" in compiled.used:
            raise EngineError("llm_guard_refused", "orders")

    run = lambda sql: engine(spark, sf).run(sql, options=Options(review=reviewer))
    return _refusals(spark, ("refused", lambda: run("SELECT o_orderkey FROM orders")), ("passed", lambda: run("SELECT n_name FROM nation")))


@query("gov_cache", "SELECT * FROM (VALUES (0, FALSE), (1, TRUE), (2, FALSE)) v(nth, cached)")
def _gov_cache(spark, sf):
    e = engine(spark, sf)
    texts = [("SELECT 1 FROM nation", "auto"), ("SELECT 1 FROM nation", "auto"), ("SELECT 1 FROM nation", "er")]
    return spark.createDataFrame([(k, e.compile(t, options=Options(source_schema=s)).cached) for k, (t, s) in enumerate(texts)], "nth int, cached boolean")


query("gr_sql_preview", "SELECT '((t.d >= :start) AND (t.d < :end) AND t.x IN (1, ''its''))' AS text")(
    lambda spark, sf: spark.createDataFrame([(frontends.preview(call("and", call("ge", Ref("d", "t"), Param("start")), call("lt", Ref("d", "t"), Param("end")), call("in", Ref("x", "t"), 1, "its"))),)], "text string")
)


@query("ds_route", "SELECT * FROM (VALUES ('one', 'lake'), ('two', 'cross_database_not_supported'), ('told', 'other')) v(what, connection)")
def _ds_route(spark, sf):
    a, b = Table("a", lambda s: None), Table("b", lambda s: None, connection="other")

    def routed(*args):
        try:
            return check_connections(*args)[0]
        except EngineError as e:
            return e.code

    return spark.createDataFrame([("one", routed([a])), ("two", routed([a, b])), ("told", routed([a], "other"))], "what string, connection string")


query("ds_default_schema", "SELECT * FROM (VALUES ('nation', 'db.main.nation'), ('dbo.t', 'db.dbo.t'), ('er.m.Client', 'er.m.Client')) v(asked, name)")(
    lambda spark, sf: spark.createDataFrame([(x, str(QName.parse(x))) for x in ("nation", "dbo.t", "er.m.Client")], "asked string, name string")
)
