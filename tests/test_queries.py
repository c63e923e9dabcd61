"""Every query of the core with SQL gives the SQL's rows, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from arzyab.plans import catalog


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


def same(spark, duck, small, query, sql):
    df = query(spark, small)
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    want = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()], key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, small, name):
    same(spark, duck, small, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, small, name):
    assert catalog.queries()[name](spark, small).count() >= 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
