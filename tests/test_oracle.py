"""Every query with SQL against DuckDB on the smallest tables, and the others by running them."""

import glob
import os

import duckdb
import pytest

from strandlake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def norm(v):
    return "nan" if v != v else f"{v:.8g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(x[names.index(c)]) for c in df.columns) for x in r.fetchall())
    assert sorted(tuple(map(norm, x)) for x in rows) == want


def test_sql_has_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
