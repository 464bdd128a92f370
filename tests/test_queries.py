"""Every registered query against its SQL, and what its plan must not contain."""

import duckdb
import pytest

import __spark_entry__
from tallygrid.queries import ORACLES, QUERIES, TABLES
from tools.compare import difference


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, db, small, name):
    found = QUERIES[name](spark, small).toPandas()
    assert difference(found, db.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert ORACLES.keys() <= __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", [
    "profile_table", "profile_base", "profile_numeric", "profile_sql", "histogram", "join_inner", "join_theta",
    "join_left", "join_full", "join_semi", "join_anti", "win_rank", "win_lag_lead", "agg_quantile", "sql_recursive",
])
def test_no_pairwise_products(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_profile_reads_the_value_counts_once(spark, small):
    from tallygrid.operators.profile import profile_table
    frame = profile_table(spark.read.parquet(f"{small}/lineitem.parquet"), "lineitem")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "WindowGroupLimit" in plan


def test_scans_are_pruned(spark, small):
    from tallygrid.operators.profile import profile_column
    from tallygrid.operators.columns import filter_not_null
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = profile_column(lines, "l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" in plan and "l_comment" not in plan and "l_quantity" not in plan
    plan = filter_not_null(lines, "l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_tax)]" in plan
