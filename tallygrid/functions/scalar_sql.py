"""Scalar functions for SQL text that Spark does not have by name.

They are plain SQL functions of the session: Spark inlines them into the plan,
so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallygrid.functions.columns import STRFTIME_CODES


def _pattern_sql() -> str:
    """SQL that turns the argument `format` into a date_format pattern."""
    # letters that belong to no code are quoted before the codes are replaced
    sql = r"regexp_replace(format, '(?<!%)([A-Za-z]+)', '\'$1\'')"
    for code, pattern in STRFTIME_CODES.items():
        sql = f"replace({sql}, '{code}', '" + pattern.replace("'", "\\'") + "')"
    return sql


def register_functions(spark: SparkSession) -> None:
    """Make `strftime` and `datetime` known to the session's SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strftime(moment TIMESTAMP_NTZ, format STRING) "
        f"RETURNS STRING RETURN date_format(moment, {_pattern_sql()})"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION datetime(text STRING) "
        "RETURNS TIMESTAMP_NTZ RETURN try_cast(text AS TIMESTAMP_NTZ)"
    )
