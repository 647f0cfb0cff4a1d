"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(n for n in entry.oracle_sql() if n.startswith("q_"))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(entry.oracle_sql()[name])
    place = [c[0] for c in cursor.description]
    assert sorted(place) == columns
    want = sorted((tuple(plain(r[place.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    same_rows(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql_or_a_reason():
    without = {n for n in entry.queries() if n.startswith("q_")} - set(NAMES)
    assert not without


@pytest.mark.parametrize("name", ["q_V12_anchor", "q_H1", "q_H2", "q_H4", "q_H4_rename", "q_U7"])
def test_path_query_sends_no_table_of_nodes_through_the_driver(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
