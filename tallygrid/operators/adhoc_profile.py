"""Profiles of columns whose type says nothing: query results and dirty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.plans.counted_quantiles import counted_quantiles
from tallygrid.plans.order_statistics import LINEAR, ORDINAL, QUARTILES, Quantile
from tallygrid.types import BOOLEAN, STRING, category, clean, col, field, is_numeric, percent, text_to_double

# Texts that mean "no value", share of numbers that makes a column
# numeric, length of the top list
MISSING_TEXTS = ("", "NULL")
NUMERIC_SHARE = 0.5
TOP_VALUES = 10

_ORDINAL_QUARTILES = (
    Quantile("median_value", 0.5, LINEAR), Quantile("q1_value", 0.25, ORDINAL), Quantile("q3_value", 0.75, ORDINAL)
)


def as_number(value: Column, data_type: T.DataType) -> Column:
    """The value as a double where its type or its text allows, else NULL."""
    if is_numeric(data_type) or category(data_type) == BOOLEAN:
        return value.cast("double")
    if category(data_type) == STRING:
        return text_to_double(value)
    return F.lit(None).cast("double")


def _summary(counted: DataFrame, wanted: tuple[Quantile, ...]) -> DataFrame:
    """One row of totals and statistics, from rows `(value, v, n)`.

    `v` is the value as a number. All parts read the shuffle that counted the
    values, so the query behind them runs once.
    """
    n, v = F.col("n"), F.col("v")
    mean = F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n)))
    centre = counted.agg(mean.alias("mean")).scalar()
    keyed = counted.select(F.lit(0).alias("k"), "v", "n")
    quantiles = counted_quantiles(keyed, ["k"], wanted, few_groups=True)
    totals = counted.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"), F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), n)), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("numbers"),
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), mean.alias("mean_value"),
        F.sum(n * (v - centre) * (v - centre)).alias("spread"),
    )
    found = quantiles.select(F.struct(*[q.name for q in wanted])).scalar()
    several = F.col("numbers") > 1
    return totals.withColumns({
        "std_value": F.when(several, F.sqrt(F.col("spread") / (F.col("numbers") - 1))),
        "found": found,
    }).withColumns({q.name: F.col(f"found.{q.name}") for q in wanted})


_STATISTICS = ("min_value", "max_value", "mean_value", "median_value", "std_value", "q1_value", "q3_value")


def profile_sql_column(df: DataFrame, column: str) -> DataFrame:
    """One-row profile of a column of any query result.

    `numeric` when every value casts to a double, `unknown` when there is no
    value at all, else `text`.
    """
    data_type = field(df, column).dataType
    counted = _groupable(df, column).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    summary = _summary(counted.withColumn("v", as_number(F.col("value"), data_type)), QUARTILES)
    return _described(summary, F.lit(column))


def _comparable(df: DataFrame, column: str) -> Column:
    """A text for each value, equal for equal values only."""
    data_type = field(df, column).dataType
    if isinstance(data_type, T.BinaryType):
        return F.hex(col(column))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return (col(column) + F.lit(0.0).cast(data_type)).cast("string")  # both zeros are one value
    return col(column).cast("string")


def profile_sql_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """`profile_sql_column` of several columns of a query result, a row each; the query runs once for all.

    Values of all columns are counted together, as texts with the number they stand for.
    """
    cells = F.array(*(
        F.struct(F.lit(k).alias("k"), _comparable(df, c).alias("value"), as_number(col(c), field(df, c).dataType).alias("v"))
        for k, c in enumerate(columns)))
    counted = df.select(F.explode(cells).alias("cell")).select("cell.*").groupBy("k", "value", "v").agg(F.count(F.lit(1)).alias("n"))
    n, v = F.col("n"), F.col("v")
    mean = F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n)))
    totals = counted.groupBy("k").agg(
        F.sum(n).alias("total_rows"), F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), n)), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("numbers"),
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), mean.alias("mean_value"))
    # a row per column
    centres = counted.groupBy("k").agg(mean.alias("centre"))
    spread = counted.join(F.broadcast(centres), "k").groupBy("k").agg(F.sum(n * (v - F.col("centre")) * (v - F.col("centre"))).alias("spread"))
    quantiles = counted_quantiles(counted.select("k", "v", "n"), ["k"], QUARTILES, few_groups=True)
    named = df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, column_name string")
    found = named
    for part in (totals, spread, quantiles):
        found = found.join(F.broadcast(part), "k", "left")
    found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_rows", "unique_count", "present", "numbers")}).withColumn(
        "std_value", F.when(F.col("numbers") > 1, F.sqrt(F.col("spread") / (F.col("numbers") - 1))))
    return _described(found, F.col("column_name"))


def _described(summary: DataFrame, name: Column) -> DataFrame:
    numeric = (F.col("present") > 0) & (F.col("numbers") == F.col("present"))
    missing = F.col("total_rows") - F.col("present")
    return summary.select(
        name.alias("column_name"),
        F.when(F.col("present") == 0, "unknown").when(numeric, "numeric").otherwise("text").alias("dtype"),
        "total_rows", "unique_count", missing.alias("missing_count"),
        percent(missing, F.col("total_rows")).alias("missing_percentage"), numeric.alias("is_numeric"),
        *[F.when(numeric, clean(F.col(c))).alias(c) for c in _STATISTICS],
    )


def _groupable(df: DataFrame, column: str) -> DataFrame:
    """The column as `value`; maps and the like are grouped by their text."""
    atomic = category(field(df, column).dataType) != "other"
    return df.select((col(column) if atomic else col(column).cast("string")).alias("value"))


def top_values(df: DataFrame, column: str, limit: int = TOP_VALUES) -> DataFrame:
    """`(value, n)` of the most frequent values, NULL excluded."""
    return (
        _groupable(df, column).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value").asc()).limit(limit)
        .select(F.col("value").cast("string").alias("value"), "n")
    )


def _present_text(df: DataFrame, column: str) -> Column:
    """The value as text, NULL for every way of saying there is none."""
    text = col(column).cast("string")
    return F.when(~text.isin(*MISSING_TEXTS), text)


def profile_lenient(df: DataFrame, column: str) -> DataFrame:
    """One-row profile of a dirty column, over all its rows.

    Missing is NULL, the empty text or the text NULL. When more than half of
    the rest parse as numbers, the statistics cover those numbers; the quartiles
    are then the values at positions n/4 and 3n/4 of the sorted numbers.
    """
    field(df, column)
    texts = df.select(_present_text(df, column).alias("value"))
    counted = texts.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    summary = _summary(counted.withColumn("v", text_to_double(F.col("value"))), _ORDINAL_QUARTILES)
    numeric = F.col("numbers") > F.col("present") * NUMERIC_SHARE
    several = numeric & (F.col("numbers") > 1)
    missing = F.col("total_rows") - F.col("present")
    share = F.try_divide(missing.cast("double"), F.col("total_rows").cast("double")) * 100
    return summary.select(
        F.lit(column).alias("column_name"), F.when(numeric, "numeric").otherwise("text").alias("dtype"),
        "total_rows", "unique_count", missing.alias("missing_count"),
        F.coalesce(share, F.lit(0.0)).alias("missing_percentage"), numeric.alias("is_numeric"),
        *[
            F.when(several if name in ("std_value", "q1_value", "q3_value") else numeric, F.col(name)).alias(name)
            for name in _STATISTICS
        ],
    )


def lenient_top_values(df: DataFrame, column: str, limit: int = TOP_VALUES) -> DataFrame:
    """`(value, n)` of the most frequent texts that are not missing."""
    return top_values(df.select(_present_text(df, column).alias(column)), column, limit)
