"""Every query with SQL equals DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from sedimenta.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    a, b = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def rows(found, names):
        at = [names.index(c) for c in cols]
        return Counter(tuple(plain(r[i]) for i in at) for r in found)

    assert rows(a.collect(), a.columns) == rows(b.fetchall(), list(b.columns))


def test_whole_tables_are_ordered_with_nulls_last(spark, db):
    for name in ("sql_order_asc", "sql_order_desc", "sql_order_unprojected", "sql_order_nulls_last"):
        got = [tuple(map(plain, r)) for r in QUERIES[name](spark, SF).collect()]
        assert got == [tuple(map(plain, r)) for r in db.sql(ORACLE_SQL[name]).fetchall()], name
    assert plain(None) in {x for x, in got} and len(got) == db.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
