"""Registered corpus queries against their SQL."""

import duckdb
import pytest

from tallygrid.llm.registry import ORACLES, QUERIES
from tallygrid.queries import TABLES
from tools.compare import difference
import tallygrid.llm  # noqa: F401


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert difference(QUERIES[name](spark, small).toPandas(), db.execute(ORACLES[name]).df()) is None
