"""Every query over the smallest tables, against its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    r = con.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    assert sorted(repr([plain(x) for x in row]) for row in rows) == sorted(repr([plain(row[i]) for i in order]) for row in r.fetchall())


def test_order_keys_that_are_equal_by_remainder(spark, tmp_path):
    rows = [(1, 3, "O", "1995-01-01"), (5001, 4, "O", "1995-01-01"), (10_001, 44, "F", "1995-01-01"), (2, 3, "O", "1995-01-01"), (9, 5, "O", "1999-01-01"), (8, 4, "F", "1997-05-20")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, t string").selectExpr("* except (t)", "cast(t as timestamp_ntz) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = {name: {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()} for name in ("membership_fold", "membership_conflicts", "healed_drift")}
    assert got["membership_fold"] == {("o1", "c3"), ("o5001", "c4"), ("o2", "c3"), ("o8", "c4")}
    assert {r[1:] for r in got["membership_conflicts"]} == {("c3", 2)}
    assert got["healed_drift"] == {("orders", 2, 0), ("customers", 3, 1)}


def test_entry(spark):
    assert entry.entry(spark).columns == ["edition_number", "work_id", "number", "change_kind"]


def test_all_oracles_have_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
