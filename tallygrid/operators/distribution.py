"""Histograms and frequency tables of one column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.types import col, field, is_numeric

# Default number of bins, length of the frequency list
BINS, FREQUENCIES = 20, 50


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins with their counts; empty bins are left out.

    The maximum falls into bin number `bins`. NaN and infinities have no place
    on the scale and are not counted. The bounds are a one-row scalar subquery,
    so the data is aggregated per bin on the map side and never moved whole.
    """
    field(df, column)
    value = col(column).cast("double")
    finite = df.select(value.alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != F.lit(float("inf")))
    )
    low, high = F.min("x"), F.max("x")
    width = F.when(low == high, F.lit(1.0)).otherwise((high - low) / F.lit(float(bins)))
    scale = finite.agg(F.struct(low.alias("low"), width.alias("width")).alias("s"))
    binned = finite.select("x", scale.scalar().alias("s")).select(
        F.floor((F.col("x") - F.col("s.low")) / F.col("s.width")).cast("bigint").alias("bin"), "s"
    )
    return (
        binned.groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s"))
        .select("bin", (F.col("s.low") + F.col("bin") * F.col("s.width")).alias("bin_start"), "n")
        .orderBy("bin")
    )


def frequency(df: DataFrame, column: str, limit: int = FREQUENCIES) -> DataFrame:
    """The most frequent values with NULL counted as the text `NULL`."""
    field(df, column)
    value = col(column)
    return (
        df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("v").asc_nulls_last())
        .limit(limit)
        .select(F.coalesce(F.col("v").cast("string"), F.lit("NULL")).alias("value"), "n")
    )


def distribution(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """A histogram for a numeric column, a frequency table for any other."""
    if is_numeric(field(df, column).dataType):
        return histogram(df, column, bins)
    return frequency(df, column)
