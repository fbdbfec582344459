"""Every core query with SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DIR):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return c


def rows(table):
    def cell(v):
        return None if isinstance(v, float) and v != v else v

    return sorted(repr(sorted((k, cell(v)) for k, v in r.items())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toArrow()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
