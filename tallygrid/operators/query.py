"""SQL queries with paged results, a total count, and errors as part of the answer."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tallygrid.operators.sql_text import adapted, spread_ranks
from tallygrid.plans.paging import page

# Fixed value: rows of a page when none are asked for
PAGE_ROWS = 1_000


# what a statement can fail with; all of it belongs in the answer
FAILURES = (PySparkException, Py4JJavaError, ValueError)


@dataclass
class ResultPage:
    columns: list[str] = field(default_factory=list)
    data: list[list[Any]] = field(default_factory=list)
    row_count: int = 0
    total_rows: int = 0
    execution_time: float = 0.0
    error: str | None = None


def parse(spark: SparkSession, sql: str) -> DataFrame:
    """The statement as a DataFrame; one trailing semicolon is allowed. Functions and NULL order mean what `sql_text` says."""
    text = adapted(spark, sql.strip().removesuffix(";"))
    return spread_ranks(spark, text, spark.sql(text))


def total_rows(df: DataFrame) -> int:
    return df.count()


def fetch(df: DataFrame, limit: int = PAGE_ROWS, offset: int = 0) -> ResultPage:
    """One page of rows and the count of all, from the same analysed plan."""
    if not df.columns:
        return ResultPage()
    rows = [list(r) for r in page(df, limit, offset).collect()]
    # a first page that is not full has shown everything there is
    total = len(rows) if offset == 0 and len(rows) < limit else total_rows(df)
    return ResultPage(df.columns, rows, len(rows), total)


def execute(spark: SparkSession, sql: str, limit: int = PAGE_ROWS, offset: int = 0) -> ResultPage:
    """Run any statement. Statements that give no rows return an empty page."""
    started = time.perf_counter()
    try:
        result = fetch(parse(spark, sql), limit, offset)
    except FAILURES as error:
        result = ResultPage(error=str(error))
    result.execution_time = time.perf_counter() - started
    return result
