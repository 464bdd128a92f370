"""The ready-made queries on one column of a table.

NULL sorts last in both directions. Ties are broken by the remaining columns,
so that a sort by a column with few values still splits into even ranges and
always gives the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tallygrid.types import col, field


def _order(df: DataFrame, column: str, descending: bool) -> list[Column]:
    field(df, column)
    first = col(column).desc_nulls_last() if descending else col(column).asc_nulls_last()
    rest = [
        col(f.name).asc_nulls_last()
        for f in df.schema.fields
        if f.name != column and not isinstance(f.dataType, (MapType, VariantType))
    ]
    return [first, *rest]


def sort_asc(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*_order(df, column, descending=False))


def sort_desc(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*_order(df, column, descending=True))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The column's values, each once; NULL is one of them."""
    return df.select(col(column)).distinct().orderBy(col(column).asc_nulls_last())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return (
        df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), col(column).asc_nulls_last())
    )


group_statistics = value_counts


def filter_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(col(column).isNull())


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(col(column).isNotNull())


def project_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column))


def top_n(df: DataFrame, n: int, *order_by: Column) -> DataFrame:
    """The first `n` rows of an order; one bounded heap per task."""
    return df.orderBy(*order_by).limit(n)


# the menu entries by name
COLUMN_QUERIES = {
    "order_asc": sort_asc,
    "order_desc": sort_desc,
    "distinct": distinct_values,
    "count": value_counts,
    "group_by": group_statistics,
    "filter_null": filter_null,
    "filter_not_null": filter_not_null,
}


def not_in(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """The rows whose value is NOT IN a column of another table, by SQL's rule for NULL.

    A NULL on either side makes the answer unknown, unless the other table is empty. Two
    counts of the other table tell that, so neither side has to be shipped whole.
    """
    listed = others.select(col(other).alias("__listed"))
    counts = F.struct(F.count(F.lit(1)).alias("all"), F.count("__listed").alias("known"))
    facts = listed.agg(counts.alias("facts")).scalar()
    rows = df.withColumn("__value", col(column))
    kept = rows.join(listed.distinct(), F.col("__value") == F.col("__listed"), "left_anti").withColumn("__facts", facts)
    all_known = F.col("__facts.all") == F.col("__facts.known")
    open_ = (F.col("__facts.all") == 0) | (all_known & F.col("__value").isNotNull())
    return kept.where(open_).select(*[col(c) for c in df.columns])
