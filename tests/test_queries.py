"""Each query with an oracle gives the oracle's rows, on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from binloom.plans import proxies

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return con


@pytest.mark.parametrize("name", list(proxies.ORACLE_SQL))
def test_same_rows(spark, tables, name):
    got = driver.queries()[name](spark, FOLDER)
    want = tables.sql(driver.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(rows, key=repr)
    assert key(plain(tuple(r)) for r in got.select(columns).collect()) == key(plain(r) for r in want.select(*columns).fetchall())


def test_entry(spark):
    if FOLDER.endswith("sf0.001"):
        assert driver.entry(spark).columns == ["scaffold", "genus", "bits"]


@pytest.mark.parametrize("name", ["genus_assign", "marker_semijoin"])
def test_scans_read_the_columns_they_need(spark, name):
    plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "PushedFilters" in plan
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
