"""Every query of the recordings library against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from sparktrode.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, (str, bool, datetime.date)):
        return repr(v)
    return repr(round(float(v), 5) + 0.0) if isinstance(v, (float, decimal.Decimal)) else repr(int(v))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    rel = duck.sql(SQL[name])
    assert got == table(rel.columns, rel.fetchall())


def test_entry_without_llm(spark):
    assert registry.FLAGSHIP in QUERIES
