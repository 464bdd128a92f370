"""Data changes and column changes as table-in, table-out operators.

Parquet tables are never edited in place: the result is written as a new
version of the table (see `operators.catalog`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.types import col, field, quoted


def insert(df: DataFrame, rows: DataFrame, by_position: bool = False) -> DataFrame:
    """The table with `rows` added, matched by column name.

    `by_position` is the rule of an INSERT statement: the first value goes to
    the first column, and so on, cast to the column's type.
    """
    if not by_position:
        return df.unionByName(rows, allowMissingColumns=True)
    if len(rows.columns) != len(df.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(df.columns)} columns")
    named = rows.toDF(*df.columns)
    return df.union(named.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def insert_named(df: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The table with `rows` added whose values belong to `columns`, the others NULL."""
    for c in columns:
        field(df, c)
    named = rows.toDF(*columns)
    return df.union(named.select(*[
        (col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def update(df: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> DataFrame:
    """New values where the condition is true; unknown leaves a row alone."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    changed = {
        name: F.when(hit, value).otherwise(col(name)).cast(field(df, name).dataType)
        for name, value in assignments.items()
    }
    # all assignments see the old row
    return df.select(*[changed[n].alias(n) if n in changed else col(n) for n in df.columns])


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """The table without the rows for which the condition is true."""
    if where is None:
        return df.limit(0)
    return df.where(~F.coalesce(where, F.lit(False)))


def add_column(df: DataFrame, name: str, data_type: str, default: Column | None = None) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column exists: {name}")
    value = default if default is not None else F.lit(None)
    return df.withColumn(name, value.cast(data_type))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    field(df, old)
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    field(df, name)
    return df.drop(F.col(quoted(name)))
