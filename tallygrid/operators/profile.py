"""Column and table profiles: counts, distinct values, statistics, top values.

Two passes cover a whole table however many columns it has: one plain aggregate
with no shuffle to speak of, and one value count (see `plans.cells`), which gives
distinct counts, top values and quantiles from a single shuffle. The pieces are
joined on the column position; each has one row per column, so broadcasting them
is bounded by the schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.plans.cells import ValueCounts
from tallygrid.plans.order_statistics import QUARTILES
from tallygrid.types import STRING, category, clean, clean_sql, col, is_numeric, numeric_columns, percent, quoted, string_columns

# aggregation buffers per pass: whole-stage codegen gives up beyond 100 fields
_BUFFERS_PER_PASS = 90
# Bytes assumed per row, length of the top list, severity bands in percent
BYTES_PER_ROW = 100
TOP_VALUES = 10
SEVERE_ABOVE, WARN_ABOVE = 50, 20

_NUMERIC = ("min_value", "max_value", "mean_value", "std_value")
_LENGTHS = ("min_length", "max_length", "avg_length")


def _aggregates(f: T.StructField, k: int, statistics: bool) -> tuple[list[Column], int]:
    """The aggregates of one column and the buffer fields they take.

    Written as SQL text: a wide table needs hundreds of them, and one parsed
    expression costs a single call to the JVM.
    """
    name = quoted(f.name)
    out, buffers = [f"count({name}) AS n_{k}"], 1
    if statistics and is_numeric(f.dataType):
        out += [
            f"{fn}(CAST({name} AS DOUBLE)) AS {label}_{k}"
            for label, fn in zip(_NUMERIC, ("min", "max", "avg", "stddev_samp"))
        ]
        buffers += 7
    elif statistics and category(f.dataType) == STRING:
        out += [f"{fn}(length({name})) AS {label}_{k}" for label, fn in zip(_LENGTHS, ("min", "max", "avg"))]
        buffers += 4
    return [F.expr(e) for e in out], buffers


def _statistics_row(f: T.StructField, k: int, statistics: bool) -> str:
    numeric = statistics and is_numeric(f.dataType)
    text = statistics and category(f.dataType) == STRING
    fields = {
        "k": str(k),
        "total_count": "total_count",
        "null_count": f"total_count - n_{k}",
    }
    for label in _NUMERIC:
        fields[label] = clean_sql(f"{label}_{k}") if numeric else "CAST(NULL AS DOUBLE)"
    for label in ("min_length", "max_length"):
        fields[label] = f"CAST({f'{label}_{k}' if text else 'NULL'} AS BIGINT)"
    # an average length of zero is reported as missing
    fields["avg_length"] = f"nullif(round(avg_length_{k}, 2), 0.0D)" if text else "CAST(NULL AS DOUBLE)"
    return "named_struct(" + ", ".join(f"'{label}', {e}" for label, e in fields.items()) + ")"


def column_statistics(df: DataFrame, columns: list[str] | None = None, statistics: bool = True) -> DataFrame:
    """Long frame, one row per column: counts, and the min/max/mean/length family."""
    position = {name: k for k, name in enumerate(df.columns)}
    names = list(columns if columns is not None else df.columns)
    if not names:  # no row, the same columns
        one = df.select(F.lit(None).cast("int").alias("none"))
        return column_statistics(one, ["none"], statistics).where("false")
    passes: list[list[int]] = [[]]
    used = 0
    for name in names:
        k = position[name]
        buffers = _aggregates(df.schema.fields[k], k, statistics)[1]
        if passes[-1] and used + buffers > _BUFFERS_PER_PASS:
            passes.append([])
            used = 0
        passes[-1].append(k)
        used += buffers
    frames = []
    for ks in passes:
        fields = [(df.schema.fields[k], k) for k in ks]
        row = df.agg(
            F.count(F.lit(1)).alias("total_count"),
            *[a for f, k in fields for a in _aggregates(f, k, statistics)[0]],
        )
        structs = ", ".join(_statistics_row(f, k, statistics) for f, k in fields)
        frames.append(row.select(F.expr(f"inline(array({structs}))")))
    return _described(df, reduce(DataFrame.unionByName, frames))


def _described(df: DataFrame, long: DataFrame) -> DataFrame:
    """Name, type and category by column position: a lookup in literals, not a join."""
    place = F.col("k") + 1
    looked_up = {
        "column_name": [f.name for f in df.schema.fields],
        "dtype": [f.dataType.simpleString() for f in df.schema.fields],
        "category": [category(f.dataType) for f in df.schema.fields],
    }
    return long.withColumns({n: F.element_at(F.lit(v), place) for n, v in looked_up.items()})


def _with_counts(base: DataFrame, distinct: DataFrame) -> DataFrame:
    return (
        base.join(F.broadcast(distinct), "k", "left")
        .withColumn("null_percentage", percent(F.col("null_count"), F.col("total_count")))
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)).cast("bigint"))
        .withColumn("unique_percentage", percent(F.col("unique_count"), F.col("total_count")))
    )


def profile_base(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Total, null and distinct counts with percentages, one row per column."""
    return _with_counts(
        column_statistics(df, columns, statistics=False), ValueCounts(df, columns).distinct()
    ).select(
        "column_name", "total_count", "null_count", "null_percentage", "unique_count", "unique_percentage"
    )


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Min, max, mean, median, deviation and quartiles of the numeric columns."""
    names = [c for c in numeric_columns(df) if columns is None or c in columns]
    return (
        column_statistics(df, names)
        .join(F.broadcast(ValueCounts(df, names).quantiles(QUARTILES)), "k", "left")
        .select(
            "column_name", "min_value", "max_value", "mean_value",
            *[clean(F.col(c)).alias(c) for c in ("median_value",)],
            "std_value",
            *[clean(F.col(c)).alias(c) for c in ("q1_value", "q3_value")],
        )
    )


def profile_string(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shortest, longest and average length of the text columns."""
    names = [c for c in string_columns(df) if columns is None or c in columns]
    return column_statistics(df, names).select("column_name", *_LENGTHS)


def profile_top_values(df: DataFrame, columns: list[str] | None = None, limit: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of every column in long form, NULL excluded."""
    return _described(df, ValueCounts(df, columns).top(limit)).select("column_name", "rank", "value", "n")


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Everything about every column, one row each, top values as an array."""
    names = list(columns if columns is not None else df.columns)
    counts = ValueCounts(df, names)
    entry = F.struct("rank", "value", F.col("n").alias("count"))
    top = counts.top(TOP_VALUES).groupBy("k").agg(
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")),
        ).alias("top_values")
    )
    return (
        _with_counts(column_statistics(df, names), counts.distinct())
        .join(F.broadcast(counts.quantiles(QUARTILES)), "k", "left")
        .join(F.broadcast(top), "k", "left")
        .select(
            F.col("k").cast("bigint").alias("position"),
            "column_name", "dtype", "category", "total_count", "null_count", "null_percentage",
            "unique_count", "unique_percentage", "min_value", "max_value", "mean_value",
            clean(F.col("median_value")).alias("median_value"), "std_value",
            clean(F.col("q1_value")).alias("q1_value"), clean(F.col("q3_value")).alias("q3_value"),
            *_LENGTHS,
            F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"),
        )
    )


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """`profile_columns` with the table's own figures on every row."""
    profile = profile_columns(df)
    return profile.select(
        F.lit(name).alias("table_name"),
        F.col("total_count").alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        (F.col("total_count") * BYTES_PER_ROW).alias("memory_usage"),
        "*",
    )


def profile_column(df: DataFrame, column: str) -> DataFrame:
    """The profile of one column with its `is_numeric` flag."""
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    return profile_columns(df.select(col(column))).select(
        "column_name", "dtype",
        F.col("category").isin("integer", "float").alias("is_numeric"),
        F.col("total_count").alias("total_rows"),
        "unique_count",
        F.col("null_count").alias("missing_count"),
        F.col("null_percentage").alias("missing_percentage"),
        "min_value", "max_value", "mean_value", "median_value", "std_value", "q1_value", "q3_value",
        *_LENGTHS, "top_values",
    )


def top_values_long(profile: DataFrame) -> DataFrame:
    """The `top_values` arrays of a profile as ranked rows."""
    return profile.select("column_name", F.posexplode("top_values").alias("place", "entry")).select(
        "column_name", (F.col("place") + 1).cast("bigint").alias("rank"),
        F.col("entry.value").alias("value"), F.col("entry.count").alias("n"),
    )


def dtype_summary(df: DataFrame) -> DataFrame:
    """Columns per type category, and how many values they miss together."""
    return column_statistics(df, statistics=False).groupBy("category").agg(
        F.count(F.lit(1)).alias("column_count"), F.sum("null_count").alias("null_count")
    )


def null_summary(df: DataFrame) -> DataFrame:
    """Null count per column, from one aggregate."""
    return column_statistics(df, statistics=False).select("column_name", "null_count")


def missing_report(df: DataFrame) -> DataFrame:
    """Null count, percentage and flag per column; no value is counted for it."""
    base = column_statistics(df, statistics=False)
    return base.select(
        "column_name", "null_count",
        percent(F.col("null_count"), F.col("total_count")).alias("null_percentage"),
        (F.col("null_count") > 0).alias("has_missing"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table."""
    width = len(df.columns)
    return column_statistics(df, statistics=False).agg(
        F.max("total_count").alias("total_rows"),
        F.lit(width).cast("bigint").alias("total_columns"),
        (F.max("total_count") * width).alias("total_cells"),
        F.sum("null_count").alias("total_missing"),
        percent(F.sum("null_count"), F.max("total_count") * width).alias("missing_percentage"),
    )


def missing_ranked(df: DataFrame) -> DataFrame:
    """Columns that miss values, worst first, with a severity."""
    share = F.col("null_percentage")
    severity = F.when(share > SEVERE_ABOVE, "error").when(share > WARN_ABOVE, "warning").otherwise("success")
    return (
        missing_report(df).where("has_missing")
        .select("column_name", "null_count", "null_percentage", severity.alias("severity"))
        .orderBy(share.desc(), "column_name")
    )


def numeric_summary(df: DataFrame) -> DataFrame:
    """The numeric columns' statistics together with their missing values."""
    names = numeric_columns(df)
    return (
        column_statistics(df, names)
        .join(F.broadcast(ValueCounts(df, names).quantiles(QUARTILES)), "k", "left")
        .select(
            "column_name", "dtype", "min_value", "max_value", "mean_value",
            clean(F.col("median_value")).alias("median_value"), "std_value",
            clean(F.col("q1_value")).alias("q1_value"), clean(F.col("q3_value")).alias("q3_value"),
            "null_count", percent(F.col("null_count"), F.col("total_count")).alias("null_percentage"),
        )
    )
