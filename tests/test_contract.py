"""Every registered query against its SQL on the small tables, and its plan."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from gavelwork import registry
from tests.conftest import SF
from tools.compare import TABLES, rows_of

QUERIES = {name: contract.queries()[name] for name in registry.QUERIES}
SQL = {name: contract.oracle_sql()[name] for name in registry.SQL}
EAGER = {"incremental_ingest", "touched_refresh", "stored_market_summary", "stream_daily_counts", "series_merge"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0
    assert frame.columns == contract.entry(spark).columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_in_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_task_functions_need_no_package_on_the_worker(spark):
    from pyspark import cloudpickle

    from gavelwork.sources import pages

    payload = cloudpickle.dumps(pages._item_rows)
    assert b"_Index" in payload  # carried along, not named for import
    assert os.path.isdir(SF)
