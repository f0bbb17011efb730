import hashlib

import pyarrow.parquet as pq
import pytest
from conftest import duck_rows, rows_of

import corpus_pipeline
from palisade.llm import queries, shared


def _dir(tmp_path, spark, docs, sf):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"documents": {r["doc_id"] for r in docs.select("doc_id").collect()}}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = shared.written(stage(spark, rows, sf), "stage")
        assert rows.schema.simpleString() == docs.schema.simpleString()
        kept[name] = {r["doc_id"] for r in rows.select("doc_id").collect()}
    order = list(kept.values())
    assert all(b < a for a, b in zip(order, order[1:]))
    left = rows.toPandas()
    plain = left.text.str.replace(r"[ \t-\r]+", " ", regex=True).map(lambda t: hashlib.sha256(t.encode()).digest())
    assert plain.is_unique
    assert queries.oracle_sql() and queries.queries()["op9_decontamination"](spark, sf).join(rows, "doc_id").filter("contaminated").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, rows, sf).toPandas()
    assert set(last.doc_id) == set(left.doc_id) and last.round_trip.all() and (last.n_tokens == last.ids.map(len)).all()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == set(last.doc_id)


def test_awkward_documents(spark, sf, tmp_path):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "some words here", 1), (4, "w " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_id int")
    found = corpus_pipeline.run(spark, _dir(tmp_path / "a", spark, docs, sf))
    assert found.count() >= 1
    none = corpus_pipeline.run(spark, _dir(tmp_path / "b", spark, docs.limit(0), sf))
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids", "round_trip"]


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, key):
    df = queries.queries()[key](spark, sf)
    names, expected = duck_rows(duck, queries.oracle_sql()[key])
    assert sorted(df.columns) == names and rows_of(df) == expected


def test_whole_table_queries(spark, sf):
    n = pq.read_table(f"{sf}/documents.parquet").num_rows
    for key, query in queries.queries().items():
        if key not in ("op5_chat_format", *queries.oracle_sql()):
            assert query(spark, sf).count() == n, key
    assert queries.queries()["op5_chat_format"](spark, sf).select("conv_id").distinct().count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
