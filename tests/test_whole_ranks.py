"""Ranks over all rows of a table in SQL text, worked out without a task that has all of them."""

import pytest

from tallygrid.operators import sql_text
from tallygrid.operators.query import parse
from tallygrid.operators.sql_text import adapted


@pytest.fixture(autouse=True)
def ranked_rows(spark, monkeypatch):
    monkeypatch.setattr(sql_text, "SMALL_BYTES", 0)
    spark.range(3000).selectExpr(
        "id", "nullif(id % 7, 3) AS m", "nullif(cast(id * 37 % 1999 AS double) / 4, 5) AS y", "nullif(concat('k', id % 5), 'k2') AS s",
    ).createOrReplaceTempView("ranked_rows")
    yield
    spark.catalog.dropTempView("ranked_rows")


def spread(df):
    return "__dealt" in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("order", ["m", "m DESC", "y DESC NULLS FIRST, id", "s, y DESC", "s DESC, m DESC", "id % 2 = 0 OR m > 3 NULLS FIRST, s"])
def test_ranks_are_those_of_the_window(spark, order):
    text = f"""WITH c AS (SELECT * FROM ranked_rows WHERE id > 10)
        SELECT x.id, RANK() OVER (ORDER BY {order}), 2 * DENSE_RANK() OVER w AS d FROM c AS x WHERE x.id % 3 > 0 -- FROM
        WINDOW w AS (ORDER BY {order}) ORDER BY id"""
    own, found = spark.sql(adapted(spark, text)), parse(spark, text)
    assert spread(found) and found.dtypes == own.dtypes
    assert found.collect() == own.collect()


def test_no_task_has_the_whole_table(spark):
    plan = parse(spark, "SELECT id, RANK() OVER (ORDER BY y) AS r FROM ranked_rows")._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.split("\n") if " Window [" in line and "__b#" not in line]
    assert " Window [" in plan and not whole


@pytest.mark.parametrize("text", [
    "SELECT RANK() OVER (ORDER BY x) FROM (SELECT rand() AS x FROM ranked_rows)", "WITH c AS (SELECT rand() AS x FROM ranked_rows) SELECT RANK() OVER (ORDER BY x) FROM c",
    "WITH c AS (SELECT id FROM ranked_rows LIMIT 9) SELECT RANK() OVER (ORDER BY id) FROM c", "SELECT RANK() OVER (PARTITION BY m ORDER BY y) FROM ranked_rows",
    "SELECT RANK() OVER (ORDER BY COUNT(*)) FROM ranked_rows GROUP BY m", "SELECT id + 1 AS z, ROW_NUMBER() OVER (ORDER BY id) FROM ranked_rows",
    "SELECT RANK() OVER (ORDER BY id + rand()) FROM ranked_rows", "SELECT id, m FROM ranked_rows ORDER BY m",
])
def test_other_windows_stay(spark, text):
    assert not spread(parse(spark, text)) and parse(spark, text).count()
