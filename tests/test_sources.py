import datetime as dt
import io
import json
import os
import subprocess
import sys
import zipfile
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pyspark
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palisade import EngineError
from palisade.operators import fingerprint, formats
from palisade.operators.workspace import Workspace
from palisade.sources import readers, transfer
from palisade.sources.transfer import BLOB, CACHE, FRAME, KINDS, TABLE, Location, Mover, legal


def test_pinned_fingerprints():
    reference = pa.schema(
        [
            pa.field("name", pa.string(), False), pa.field("count", pa.int64(), False), pa.field("score", pa.float64()), pa.field("amount", pa.decimal128(38, 9)),
            pa.field("ts", pa.timestamp("us", "UTC")), pa.field("d", pa.date32()), pa.field("active", pa.bool_(), False), pa.field("payload", pa.binary()),
            pa.field("meta", pa.struct([pa.field("key", pa.string(), False), pa.field("val", pa.int32())])),
        ]
    )
    scalars = pa.schema(
        [
            pa.field("i8", pa.int8(), False), pa.field("u32", pa.uint32()), pa.field("f32", pa.float32()), pa.field("flag", pa.bool_(), False),
            pa.field("price", pa.decimal128(18, 2)), pa.field("when_ms", pa.timestamp("ms")), pa.field("blob", pa.large_binary()),
        ]
    )
    assert fingerprint.fingerprint(reference).startswith("69779ea6")
    assert fingerprint.fingerprint(scalars).startswith("302cc3ee")


def test_json_rows(spark):
    df = readers.json_rows(spark, '[{"b": 1, "a": true}, {"a": null, "c": [1], "b": 2.5}]')
    assert df.dtypes == [("b", "double"), ("a", "boolean"), ("c", "string")]
    assert readers.json_rows(spark, "[]").columns == []
    with pytest.raises(EngineError, match="validation_failed"):
        readers.json_rows(spark, '{"a": 1}')


def test_arrow_batches(spark):
    a = pa.record_batch({"x": pa.array([1], pa.uint8())})
    assert readers.arrow_batches(spark, [a.slice(0, 0), a, a]).dtypes == [("x", "smallint")]
    with pytest.raises(EngineError, match="schema_mismatch"):
        readers.arrow_batches(spark, [a, pa.record_batch({"y": [1]})])
    back = list(formats.arrow_batches(spark.range(25), 10))
    assert [b.num_rows for b in back] == [10, 10, 5]
    empty = list(formats.arrow_batches(spark.range(0), 10))
    assert len(empty) == 1 and empty[0].schema.names == ["id"]


def test_ipc_file(spark, tmp_path):
    table = pa.table({"n": [1, 2, 3]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert readers.ipc_file(spark, f"file://{tmp_path}/x.arrow").count() == 3
    with pytest.raises(EngineError, match="blob_too_large"):
        readers.ipc_file(spark, f"file://{tmp_path}/x.arrow", 10)


def test_jdbc_replace_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db2;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    read = lambda: sorted(tuple(r) for r in readers.jdbc_table(spark, url, "sums", **driver).collect())
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "K long, V string")
    transfer.write_jdbc(rows, url, "sums", "replace", **driver)
    assert read() == [(1, "a"), (2, "b")]
    transfer.write_jdbc(rows.filter("K = 2"), url, "sums", "replace", **driver)
    assert read() == [(2, "b")]
    plain = transfer._execute

    def failing(connection, *statements):
        plain(connection, *statements)
        if statements[0].startswith("DELETE"):
            raise RuntimeError("lost")

    monkeypatch.setattr(transfer, "_execute", failing)
    with pytest.raises(RuntimeError):
        transfer.write_jdbc(rows, url, "sums", "replace", **driver)
    assert read() == [(2, "b")]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(1, Decimal("9999999999999999.9999")), (2, Decimal("0.0001"))], "k int, v decimal(20,4)")
    transfer.write_jdbc(rows, url, "sales", "create", **driver)
    back = readers.jdbc_table(spark, url, "sales", partition=("K", 1, 3, 2), **driver)
    assert sorted(tuple(r) for r in back.collect()) == [(1, Decimal("9999999999999999.9999")), (2, Decimal("0.0001"))]
    with pytest.raises(EngineError, match="unsupported_type"):
        transfer.write_jdbc(spark.sql("SELECT array(1) AS a"), url, "bad", "create", **driver)
    with pytest.raises(EngineError, match="tenant_id_required"):
        readers.jdbc_table(spark, url, "sales", tenant="x'; DROP")
    with pytest.raises(EngineError, match="identifier"):
        readers.jdbc_table(spark, url, "sales; DROP TABLE x")


def test_packed_database_keeps_null_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "é"), (1, "é"), (2, ""), (3, None), (None, "x")], "K int, V string")
    for n in (5, 0):
        url = transfer.packed_database(rows.limit(n), "kept")
        back = readers.jdbc_table(spark, url, "kept", partition=("K", 1, 3, 2), **transfer.DERBY)
        assert back.dtypes == rows.dtypes
        assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.limit(n).collect()))


_ON_EXECUTORS = """
import sys
from palisade.plans.catalogue import QUERIES
from palisade.session import session

spark = session("cluster", spark__master="local-cluster[2,1,1024]", spark__executor__memory="800m", spark__driver__host="127.0.0.1", spark__ui__enabled="false")
print("rows", sorted(tuple(r) for r in QUERIES["src_jdbc_table"](spark, sys.argv[1]).collect()))
"""


def test_jdbc_table_is_read_by_executors_of_their_own(sf, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    repo = str(Path(__file__).parent.parent)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", _ON_EXECUTORS, sf], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    nations = pq.read_table(f"{sf}/nation.parquet").to_pydict()
    assert f"rows {sorted(zip(nations['n_nationkey'], nations['n_name']))}" in done.stdout


def test_legality_matrix():
    at = {k: Location(k, "a") for k in KINDS}
    other = {k: Location(k, "b") for k in KINDS}
    for s in KINDS:
        assert legal("describe", at[s]) == "allowed"
        assert legal("evict", at[s]) == ("disallowed" if s == TABLE else "allowed")
        for t in KINDS:
            assert legal("stage", at[s], other[t]) == ("allowed" if t == FRAME else "disallowed")
            assert legal("copy", at[s], other[t]) == ("disallowed" if s == t == FRAME else "allowed")
            assert legal("materialize", at[s], other[t]) == ("disallowed" if t == FRAME or s == t == TABLE else "allowed")
        assert legal("copy", at[s], at[s]) == "same_location"


def test_moves(spark, tmp_path):
    m = Mover(spark, f"file://{tmp_path}/base", Workspace(), writable=("good",))
    blob, cache, frame = Location(BLOB, "a/b"), Location(CACHE, "k"), Location(FRAME, "f", "s")
    m.write(spark.range(5), blob)
    mark = m.move("copy", blob, cache, ttl=100)["fingerprint"]
    assert m.describe(cache, count=True)["rows"] == 5 and m.describe(cache)["expires"] and m.describe(blob)["rows"] == -1
    assert m.move("copy", blob, blob) == {"moved": False, "note": "same location"}
    with pytest.raises(EngineError, match="target_exists"):
        m.move("copy", cache, blob)
    with pytest.raises(EngineError, match="fingerprint_mismatch"):
        m.move("stage", blob, frame, expect="0" * 64)
    m.move("stage", blob, frame, expect=mark)
    assert m.read(frame).count() == 5
    with pytest.raises(EngineError, match="illegal_move"):
        m.move("materialize", blob, frame)
    with pytest.raises(EngineError, match="write_not_allowed"):
        m.move("copy", blob, Location(TABLE, "bad.t"))
    m.move("copy", blob, cache, ttl=-1)
    with pytest.raises(EngineError, match="cache_expired"):
        m.read(cache)
    assert m.evict(cache) and m.evict(Location(BLOB, "a/")) and m.evict(frame) and not m.evict(frame)
    with pytest.raises(EngineError, match="illegal_move"):
        m.evict(Location(TABLE, "x"))


def test_table_modes(spark, tmp_path):
    m = Mover(spark, f"file://{tmp_path}/base", Workspace())
    t, df = Location(TABLE, "moves_t"), spark.range(3)
    m.write(df, t, "create")
    with pytest.raises(EngineError, match="target_exists"):
        m.write(df, t, "create")
    m.write(df, t, "append")
    assert m.read(t).count() == 6
    with pytest.raises(EngineError, match="schema_mismatch"):
        m.write(df.withColumnRenamed("id", "x"), t, "append")
    m.write(spark.range(2), t, "replace")
    assert m.read(t).count() == 2
    with pytest.raises(EngineError, match="unsupported_type"):
        m.write(spark.sql("SELECT map(1, 2) AS m"), t, "replace")
    spark.sql("DROP TABLE moves_t")


def test_workspace_caps_and_expiry(spark):
    clock = [0.0]
    w = Workspace(sessions=1, frames=2, idle_seconds=10, clock=lambda: clock[0])
    w.put("s", "a", spark.range(3))
    w.put("s", "a", spark.range(4))
    w.put("s", "b", spark.range(3))
    assert w.get("s", "a").count() == 4 and spark.table(Workspace.view("s", "a")).count() == 4 and w.names("s") == ["a", "b"]
    for code, f in (("workspace_cap_exceeded", lambda: w.put("s", "c", spark.range(1))), ("workspace_cap_exceeded", lambda: w.put("t", "c", spark.range(1))), ("workspace_requires_session", lambda: w.put("", "c", spark.range(1))), ("workspace_not_found", lambda: w.get("t", "a"))):
        with pytest.raises(EngineError, match=code):
            f()
    with pytest.raises(EngineError, match="bytes of a frame"):
        Workspace(frame_bytes=1).put("s", "a", spark.range(100))
    clock[0] = 11
    assert w.sweep() == 2 and not w.drop("s", "a")


def test_formats(spark):
    df = spark.createDataFrame([(1, 'a,"b"\n', None), (2, None, dt.datetime(2024, 1, 2, 3))], "n int, s string, t timestamp_ntz")
    assert formats.render(df, "csv")[0] == b'n,s,t\r\n1,"a,""b""\n",\r\n2,,2024-01-02T03:00:00\r\n'
    assert formats.render(df, "tsv")[0] == b'n\ts\tt\n1\ta,"b"\\n\t\n2\t\t2024-01-02T03:00:00\n'
    assert b"| 1 | a,\"b\"  | null |" in formats.render(df, "markdown")[0]
    assert json.loads(formats.render(df, "json", labels={"n": "N"})[0])["__columnLabels"] == {"n": "N"}
    assert pq.read_table(io.BytesIO(formats.render(df, "parquet")[0])).schema.field("t").type == pa.timestamp("ms")
    sheet = zipfile.ZipFile(io.BytesIO(formats.render(df, "xlsx")[0])).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 3 and "<v>1</v>" in sheet
    for form in ("yaml",):
        with pytest.raises(EngineError, match="format_failed"):
            formats.render(df, form)
    with pytest.raises(EngineError, match="format_failed"):
        formats.render(spark.sql("SELECT array(1) AS a"), "csv")
    with pytest.raises(EngineError, match="invalid_regex"):
        formats.hide(df, ["("])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.integers(-(2**40), 2**40), st.none() | st.text(st.characters(exclude_categories=("Cs",)), max_size=20)), max_size=20), st.integers(1, 30))
def test_formats_keep_and_cut_rows(spark, rows, limit):
    df = spark.createDataFrame(rows, "n long, s string")
    for form in ("json", "parquet"):
        body, more = formats.render(df, form, limit)
        back = json.loads(body) if form == "json" else pq.read_table(io.BytesIO(body)).to_pylist()
        assert len(back) == min(limit, len(rows)) and more == (len(rows) > limit)
        assert sorted(map(repr, ((r["n"], r["s"]) for r in back))) == sorted(map(repr, rows)) or more
