import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palisade.session import session

    s = session(
        "tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v):
    import decimal

    return f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def duck_rows(duck, sql):
    found = duck.sql(sql)
    order = [found.columns.index(n) for n in sorted(found.columns)]
    return sorted(found.columns), sorted(tuple(cell(r[k]) for k in order) for r in found.fetchall())
