"""Every registered query against its SQL on the smallest tables, and the contract of the entry file."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def key(v):
    if isinstance(v, (list, tuple)):
        return (3, tuple(key(x) for x in v))
    if v is None:
        return (0, 0)
    return (1, float(v)) if isinstance(v, (bool, int, float)) else (2, str(v))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b or all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b)
        ), (a, b)


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_plans_have_no_cross_products(spark):
    """Only single-row tables are joined without a key."""
    for name in ("feature_table", "window_match", "sequence_features", "baseline_wls", "reference_residuals"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
