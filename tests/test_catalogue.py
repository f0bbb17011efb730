"""Every query against its SQL."""

import re

import pytest
from conftest import duck_rows, rows_of

from palisade.plans.catalogue import ORACLE, QUERIES

#: Keys that stand for the same query as another.
DISTINCT = {id(f): k for k, f in reversed(list(QUERIES.items()))}


@pytest.mark.parametrize("key", sorted(set(DISTINCT.values()) & set(ORACLE)))
def test_same_rows(spark, sf, duck, key):
    df = QUERIES[key](spark, sf)
    names, expected = duck_rows(duck, ORACLE[key])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_match_finds_the_word_with_a_letter_lost(spark, sf):
    found = QUERIES["fz_score"](spark, sf).filter("nth = 1").collect()
    assert found and all(0 < r["score"] <= 1.5 for r in found)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A part table of 260 rows in which the last ones have words of their own."""
    d = str(tmp_path_factory.mktemp("parts"))
    rows = [(k, f"{'small' if k % 2 else 'large'} {'ring' if k < 210 else 'zircon'}") for k in range(260)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    return d


def test_every_row_is_a_span(spark, parts):
    rows = QUERIES["fz_score"](spark, parts).filter("nth = 1").collect()
    assert sorted(r["span_id"] for r in rows) == list(range(260))


def test_tokens_of_every_row_are_resolved(spark, parts):
    found = {(r["query_token"], r["token"], r["distance"]) for r in QUERIES["fz_resolve"](spark, parts).collect()}
    assert found == {(w, w, 0) for w in ("small", "large", "ring", "zircon")}


def test_tokens_of_texts_beyond_ascii(spark, duck, tmp_path):
    texts = ["Žlutý kůň – „úpěl“!", "niño, ¿qué?", "a b c\x1fd\x0be", "x² ½ Ⅷ ٣", "ét", "日本語 text_1", "", None, "  \n", "plain one."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(QUERIES["nl_ops"](spark, str(tmp_path)))
    assert got == sorted((str(k), str(len(re.findall(r"\w+|[^\w\s]", x or "")))) for k, x in enumerate(texts))
    sql = ORACLE["nl_ops"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert duck_rows(duck, sql)[1] == got


def test_sentences_keep_digits_and_lose_blanks_at_their_ends(spark, duck, tmp_path):
    texts = ["0. 148.9.1. 2 of 22\n 3a3 \n4", "a\n  \n b  c ", "a.\x0bb", "a. \x0bb?\x0c\tc!\r\nd\re", "a.\xa0b. c", "x. " * 300, "...", " ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["nl_sentences"](spark, str(tmp_path))
    assert [r["sentence"] for r in df.filter("doc_id = 0").orderBy("nth").collect()] == ["0.", "148.9.1.", "2 of 22", "3a3", "4"]
    sql = ORACLE["nl_sentences"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert duck_rows(duck, sql)[1] == rows_of(df)
