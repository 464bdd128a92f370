"""Catalog queries: tables with their figures, columns, and name search."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.types import category

# tables per union, so that a large catalog does not become one deep plan
_TABLES_PER_UNION = 64


def table_name_for(file_name: str, taken: set[str] = frozenset()) -> str:
    """A table name from a file name: its stem with everything but letters,
    digits and `_` replaced, `t_` before a leading digit, numbered when taken."""
    stem = file_name.rstrip("/").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem
    name = "".join(c if c.isalnum() else "_" for c in stem) or "table_1"
    if name[0].isdigit():
        name = f"t_{name}"
    return free_name(name, taken)


def free_name(name: str, taken: set[str]) -> str:
    candidate, n = name, 0
    while candidate in taken:
        n += 1
        candidate = f"{name}_{n}"
    return candidate


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """`(table_name, row_count)`, counted in one job."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    groups = [counted[i:i + _TABLES_PER_UNION] for i in range(0, len(counted), _TABLES_PER_UNION)]
    return reduce(DataFrame.unionByName, [reduce(DataFrame.unionByName, g) for g in groups])


def catalog_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every column of every table as `table.column` with type and category."""
    rows = [
        (name, f.name, f"{name}.{f.name}", position, f.dataType.simpleString(), category(f.dataType))
        for name, df in tables.items() for position, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, path string, position bigint, dtype string, category string"
    )


def catalog_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, row count and column count of every table."""
    widths = F.create_map(*[F.lit(v) for name, df in tables.items() for v in (name, len(df.columns))])
    return row_counts(tables).select(
        "table_name", "row_count", widths[F.col("table_name")].cast("bigint").alias("column_count")
    )


def search(names: DataFrame, text: str, column: str = "table_name") -> DataFrame:
    """Rows whose name contains the text, whatever the case; no text keeps all."""
    return names.where(F.contains(F.lower(column), F.lit(text.lower()))) if text else names
