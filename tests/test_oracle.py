"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from oreflow.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(DIR):
        p = f"{DIR}/{n}"
        c.execute(f"create view {n.split('.')[0]} as select * from read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"create view {n.split('.')[0]} as select * from read_parquet('{p}')")
    return c


def _form(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(names), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert _form([tuple(r) for r in got.collect()], got.columns) == _form(want.fetchall(), list(want.columns))
