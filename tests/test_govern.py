import datetime as dt
import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from palisade import EngineError
from palisade.catalog import Catalog, QName, Table, parquet_catalog
from palisade.engine import Engine, Options, PlanCache
from palisade.operators import govern as g
from palisade.plans import frontends, ir
from palisade.plans.ir import Aggregate, Call, Filter, Limit, Lit, Ref, Sub, TableScan, Union

ORDERS = [(1, "t-alpha", "EU", 100.0), (2, "t-alpha", "US", 250.5), (3, "t-beta", "EU", 42.0), (4, "t-beta", "APAC", 999.99)]


@pytest.fixture()
def samples(spark):
    orders = spark.createDataFrame(ORDERS, "id int, tenant_id string, region string, amount double")
    regions = spark.createDataFrame([("EU", "Europe"), ("US", "States"), ("APAC", "Asia")], "region string, region_name string")
    return Catalog({"sample_orders": Table("sample_orders", lambda s: orders, "dbo"), "sample_regions": Table("sample_regions", lambda s: regions, "ref")})


def engine(spark, samples, user="t-alpha:alice", policies=(g.TENANT_ISOLATION,), roles=(), **attributes):
    return Engine(spark, samples, list(policies), g.User(user, roles, attributes))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id FROM sample_orders",
        "SELECT o.id FROM sample_orders o JOIN sample_regions r ON o.region = r.region",
        "SELECT id FROM sample_orders WHERE region = 'EU' UNION ALL SELECT id FROM sample_orders WHERE region <> 'EU'",
        "SELECT id FROM (SELECT * FROM sample_orders) x",
        "WITH x AS (SELECT id, amount FROM sample_orders) SELECT id FROM x",
        "SELECT id FROM sample_orders WHERE id IN (SELECT id FROM sample_orders)",
    ],
)
def test_tenants_see_their_own_rows(spark, samples, sql):
    assert rows_of(engine(spark, samples).run(sql)) == [("1",), ("2",)]
    assert rows_of(engine(spark, samples, "t-beta:bob").run(sql)) == [("3",), ("4",)]


def test_subqueries_do_not_leak(spark, samples):
    leak = "SELECT region FROM sample_regions WHERE region IN (SELECT region FROM sample_orders)"
    assert rows_of(engine(spark, samples).run(leak)) == [("EU",), ("US",)]
    scalar = "SELECT max(region) AS r FROM sample_regions WHERE (SELECT max(amount) FROM sample_orders) < 300"
    assert rows_of(engine(spark, samples).run(scalar)) == [("US",)]
    plan = ir.Project(Filter(TableScan("sample_regions"), Sub("in", ir.Project(TableScan("sample_orders"), ((Ref("region"), "r"),)), (Ref("region"),))), ((Ref("region"), "region"),))
    assert rows_of(engine(spark, samples).run(json.dumps(frontends.to_wire(plan)), "relnode")) == [("EU",), ("US",)]


def test_no_tenant_closes_the_table(spark, samples):
    with pytest.raises(EngineError, match="policy_attribute_missing"):
        engine(spark, samples, "alice").run("SELECT id FROM sample_orders")


def test_bypass(spark, samples):
    free = Options(apply_security=False)
    assert engine(spark, samples, roles=("admin",)).run("SELECT id FROM sample_orders", options=free).count() == 4
    with pytest.raises(EngineError, match="security_bypass_denied"):
        engine(spark, samples).run("SELECT id FROM sample_orders", options=free)


def test_denied_columns(spark, samples):
    e = engine(spark, samples, policies=[g.Policy("d", g.Match("exact", "sample_orders"), deny=("amount",))])
    assert e.run("SELECT id FROM sample_orders").count() == 4
    assert e.run("SELECT count(*) AS n FROM sample_orders").first()["n"] == 4
    for sql in ("SELECT amount FROM sample_orders", "SELECT * FROM sample_orders", "SELECT id FROM sample_orders ORDER BY AMOUNT", "SELECT x.* FROM sample_orders x", "SELECT id FROM sample_orders WHERE `amount` > 1"):
        with pytest.raises(EngineError) as found:
            e.run(sql).collect()
        assert found.value.code in ("column_denied", "validation_failed")
    plan = json.dumps({"ops": [{"from": "sample_orders"}, {"filter": {"op": "gt", "args": [{"col": "amount"}, 1]}}]})
    with pytest.raises(EngineError, match="column_denied"):
        e.run(plan, "dfdsl")


def test_masked_key_warns(spark, samples):
    guard = g.Guard([g.Policy("m", g.Match(), mask={"region": "x"})], g.User("t:u"))
    plan = Aggregate(TableScan("sample_orders"), (Ref("region"),), (("count", None, False, "n"),))
    guard.warn_masked_keys(plan, [samples.tables["sample_orders"]])
    assert guard.messages == ["mask_skipped_bare_column_ref"]
    e = engine(spark, samples, policies=guard.policies)
    assert rows_of(e.run(json.dumps(frontends.to_wire(plan)), "relnode")) == [("4", "x")]


def test_user_attributes():
    user = g.User("t1:ann", attributes={"tenant_id": "forged", "level": 3})
    assert (user.attribute("tenant_id"), user.attribute("user_id"), user.attribute("level")) == ("t1", "ann", 3)
    assert g.In("c", ()).build(user)._jc.toString() == "false"


def test_caps():
    plan = Limit(TableScan("t"), 100, 5)
    assert g.cap_root(plan, 30) == Limit(TableScan("t"), 30, 5)
    assert g.cap_root(TableScan("t"), 30) == Limit(TableScan("t"), 30)
    assert g.cap_root(Limit(TableScan("t"), 7), 30).limit == 7


def test_row_limit(spark):
    rows, more = g.row_limit(spark.range(10), 4)
    assert len(rows) == 4 and more
    assert g.row_limit(spark.range(3), 4)[1] is False
    with pytest.raises(EngineError, match="row_limit_out_of_range"):
        g.row_limit(spark.range(3), 0)


def test_strict_covers_unions_and_subqueries():
    bad = Filter(TableScan("t"), Call("eq", (Ref("a"), Lit("x"))))
    for plan in (bad, Union((TableScan("t"), bad)), ir.Store("s", bad), Filter(TableScan("t"), Sub("exists", bad))):
        with pytest.raises(EngineError, match="strict_coercion_rejected"):
            g.check_strict(plan, {"a": "bigint"})
    g.check_strict(bad, {"a": "string"})


def test_one_layer_and_one_connection():
    with pytest.raises(EngineError, match="validator_mixed_layer_tree"):
        g.check_layers(Union((TableScan("t"), ir.EntityScan("E"))))
    one, two = Table("a", None, connection="x"), Table("b", None, connection="y")
    with pytest.raises(EngineError, match="cross_database_not_supported"):
        g.check_connections([one, two])
    assert g.check_connections([one], "y") == ("y", ["connection_id_overrides_derived"])


def test_sql_names():
    names, star = g.sql_names("SELECT count(*), a * b FROM `odd name` -- secret\n WHERE x = 'lit' /* c */")
    assert names >= {"count", "a", "b", "odd name", "x"} and "secret" not in names and "lit" not in names and not star
    assert g.sql_names("SELECT t.* FROM t")[1] and g.sql_names("SELECT a, * FROM t")[1]


def test_cache_keeps_schema_and_version_apart(spark, sf):
    clock = [0.0]
    e = Engine(spark, parquet_catalog(sf))
    e.cache = PlanCache(2, 10, lambda: clock[0])
    assert not e.compile("SELECT 1 FROM nation").cached and e.compile("SELECT 1 FROM nation").cached
    assert not e.compile("SELECT 1 FROM nation", options=Options(source_schema="er")).cached
    assert not e.compile("SELECT 2 FROM nation").cached and not e.compile("SELECT 1 FROM nation").cached
    clock[0] = 11
    assert not e.compile("SELECT 1 FROM nation").cached


def test_saved_queries(spark, sf):
    e = Engine(spark, parquet_catalog(sf))
    for name, code in (("nothing", "query_not_found"), ("stale", "query_failed")):
        with pytest.raises(EngineError, match=code):
            e.run(json.dumps({"core": [{"queryRef": name}]}), "transdsl")
    bound = e.run(json.dumps({"core": [{"queryRef": "orders_over", "alias": "x"}]}), "transdsl", Options(params={"least": 1e5}))
    assert bound.count() == spark.read.parquet(f"{sf}/orders.parquet").filter("o_totalprice > 100000").count()


def test_entities(spark, sf):
    masked = [g.Policy("m", g.Match("exact", "customer"), g.Eq("c_nationkey", 3), mask={"c_name": "?"})]
    e = Engine(spark, parquet_catalog(sf), masked)
    rows = e.run("SELECT id, title, country FROM Client").collect()
    assert rows and {(r["title"], r["country"]) for r in rows} == {("?", 3)}
    with pytest.raises(EngineError, match="validator_mixed_layer_tree"):
        e.run("SELECT 1 FROM Client, nation")


def test_plan_errors(spark, sf):
    e = Engine(spark, parquet_catalog(sf))
    cases = [
        ("not json", "dfdsl", "validation_failed"),
        ('{"ops": []}', "dfdsl", "validation_failed"),
        ('{"ops": [{"from": "nation"}, {"spin": 1}]}', "dfdsl", "unsupported_node"),
        ('{"is": "Nope"}', "relnode", "unsupported_node"),
        ("SELECT 1", "cobol", "unsupported_language"),
        ("SELECT n_name FROM nation WHERE n_name = {x}", "sql", "parameter_unknown"),
        ("SELECT nope FROM nation", "sql", "validation_failed"),
    ]
    for text, language, code in cases:
        with pytest.raises(EngineError, match=code):
            e.run(text, language)
    wide = json.dumps(frontends.to_wire(ir.Project(TableScan("nation"), ((Call("sqrtish", (Ref("n_name"),)), "x"),))))
    with pytest.raises(EngineError, match="unsupported_expression"):
        e.run(wide, "relnode")


def test_wire_round_trip():
    plan = Limit(Filter(TableScan("t", ("a",)), Sub("in", TableScan("u"), (Ref("a"),))), 3)
    assert frontends.relnode(json.dumps(frontends.to_wire(plan))) == plan
    assert ir.scan_set(plan) == ["t", "u"] and ir.column_names(plan) == {"a"}


def test_parameters():
    assert frontends.bind_sql("a = {x} AND b = '{x}'", {"x": 1}) == ("a = :x AND b = :x", {"x": 1})
    assert frontends.typed_param({"value": "5", "type": "int"}) == 5
    assert frontends.typed_param({"value": "2024-01-02", "type": "date"}) == dt.date(2024, 1, 2)
    assert frontends.typed_param("2024-01-02") == dt.datetime(2024, 1, 2) and frontends.typed_param("x") == "x"


def test_names_and_detection(sf):
    c = parquet_catalog(sf)
    assert str(QName.parse("db.dbo.t")) == "db.dbo.t" and QName.parse("t").namespace == "main"
    assert [c.detect(x)[0] for x in ([], ["nation"], ["Client"], ["nation", "Client"], ["nope"])] == ["NOT_APPLICABLE", "CONFIRMED_DB", "CONFIRMED_ER", "MIXED", "UNKNOWN"]
    with pytest.raises(EngineError) as found:
        c.table("natoin")
    assert "nation" in found.value.hint


def test_not_in_with_nulls(spark):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "a int"), spark.createDataFrame([(1,), (None,)], "b int")
    c = Catalog({"l": Table("l", lambda s: left), "r": Table("r", lambda s: right), "e": Table("e", lambda s: right.limit(0))})
    ask = lambda name: ir.Project(Filter(TableScan("l"), Call("not", (Sub("in", TableScan(name), (Ref("a"),)),))), ((Ref("a"), "a"),))
    run = lambda name: Engine(spark, c).run(json.dumps(frontends.to_wire(ask(name))), "relnode").count()
    assert run("r") == 0 and run("e") == 3


def test_top_n_at_the_root(spark, sf):
    assert Engine(spark, parquet_catalog(sf)).run("SELECT * FROM orders", options=Options(top_n=30)).count() == 30
    assert g.top_n(spark.range(100), 5).count() == 5 and g.top_n(spark.range(100).filter(F.col("id") < 3)).count() == 3
