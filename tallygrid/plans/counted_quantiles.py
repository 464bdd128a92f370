"""Exact quantiles from values and their counts, for any number of groups and values.

The input is one row per distinct value of a group with its count. A value is mapped to a
64-bit number of the same order, and a wanted position is found digit by digit: a round counts
the rows under each next digit of the numbers that begin as the position's does, in bins that
tasks combine before the shuffle, and the running sum over the bins tells which one holds the
position. After the last round the number is known whole, so no value is ever sorted: a
round holds at most 2^BITS bins of a group and beginning, however many values there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.plans.order_statistics import DISCRETE, LINEAR, ORDINAL, Quantile
from tallygrid.types import col

#: Bits of a digit.
BITS = 22
_K = "__keys"


def order_key(value: Column) -> Column:
    """A bigint for each double, in the same order; NaN is above all, and both zeros are one."""
    size, unit = F.abs(value), 1 << 52
    guess = F.floor(F.log2(size))
    share = size / F.pow(F.lit(2.0), guess)

    def normal(exponent: Column, mantissa: Column) -> Column:
        return (exponent + 1023) * unit + ((mantissa - 1) * float(unit)).cast("bigint")

    # the logarithm may have been rounded over a power of two
    found = F.when(share < 1, normal(guess - 1, share * 2)).when(share >= 2, normal(guess + 1, share / 2)).otherwise(normal(guess, share))
    # below 2^-1022 doubles are multiples of 2^-1074
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    top = F.lit((1 << 63) - 2)
    code = (
        F.when(size == 0, F.lit(0)).when(size == float("inf"), top)
        .when(size < 2.0**-1022, tiny).when(size >= 2.0**1023, normal(F.lit(1023), size / F.lit(2.0**1023))).otherwise(found))
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -code).otherwise(code)


def _position(q: Quantile, total: Column) -> tuple[Column, Column, Column]:
    """Zero-based neighbours and the weight of the upper one."""
    if q.rule == LINEAR:
        exact = F.lit(q.p) * (total - 1)
        low = F.floor(exact)
        return low, F.least(low + 1, total - 1), exact - low
    share = F.lit(q.p) * total
    place = {ORDINAL: F.floor(share), DISCRETE: F.greatest(F.ceil(share), F.lit(1)) - 1}[q.rule]
    place = F.least(place, total - 1)
    return place, place, F.lit(0.0)


def counted_quantiles(counted: DataFrame, keys: list[str], wanted: tuple[Quantile, ...], few_groups: bool = False) -> DataFrame:
    """`keys` and one double per quantile, from rows `(keys, v, n)` with a row per distinct value or more.

    `few_groups` tells that the groups are bounded (columns of a table), so that what is looked for fits every task.
    """
    # rows without a value weigh nothing; a filter would slip under the shared count and split it in two
    n = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    rows = counted.select(F.struct(*map(col, keys)).alias(_K), F.coalesce(order_key(F.col("v")), F.lit(0)).alias("key"), "v", n.alias("n"))
    shift = 64 - BITS
    bins = rows.groupBy(_K, F.shiftright("key", shift).alias("at")).agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    along = Window.partitionBy(_K)
    bins = bins.withColumns({"before": F.sum("n").over(along.orderBy("at")) - F.col("n"), "total": F.sum("n").over(along)})
    places, weights = {}, {}
    for i, q in enumerate(wanted):
        low, high, weight = _position(q, F.col("total"))
        places |= {f"__r{2 * i}": low.cast("bigint"), f"__r{2 * i + 1}": high.cast("bigint")}
        weights[f"__w{i}"] = weight.cast("double")
    count = len(places)
    # one row per group: of each place the bin, the place counted from the bin's first row, and the bin's largest value
    state = _found(bins.withColumns(places | weights), _K, "at", list(weights), count)
    while shift:
        step = min(BITS, shift)
        held = state.withColumnRenamed(_K, "__k").drop(*(f"__v{i}" for i in range(count)))
        found = rows.join(F.broadcast(held) if few_groups else held, F.col(_K) == F.col("__k")).withColumn("at", F.shiftright("key", shift))
        shift -= step
        kept = [*(f"__at{i}" for i in range(count)), *(f"__r{i}" for i in range(count)), *weights]
        bins = found.where(F.col("at").isin(*(F.col(f"__at{i}") for i in range(count)))).groupBy(_K, "at", F.shiftright("key", shift).alias("to")).agg(
            F.sum("n").alias("n"), F.max("v").alias("v"), *(F.first(c).alias(c) for c in kept))
        bins = bins.withColumn("before", F.sum("n").over(Window.partitionBy(_K, "at").orderBy("to")) - F.col("n"))
        state = _found(bins, _K, "to", list(weights), count)
    out = []
    for i, q in enumerate(wanted):
        low, high, weight = F.col(f"__v{2 * i}"), F.col(f"__v{2 * i + 1}"), F.col(f"__w{i}")
        between = low * (1 - weight) + high * weight
        out.append(F.when((low == high) | (weight == 0), low).otherwise(between).alias(q.name))
    return state.where("__v0 is not null").select(*[F.col(_K).getField(k).alias(k) for k in keys], *out)


def _found(bins: DataFrame, key: str, bin_: str, weights: list[str], count: int) -> DataFrame:
    """Per group the bin that holds each place."""
    later = "at" != bin_
    out = []
    for i in range(count):
        rest = F.col(f"__r{i}")
        here = (rest >= F.col("before")) & (rest < F.col("before") + F.col("n"))
        if later:
            here = here & (F.col("at") == F.col(f"__at{i}"))
        out += [F.max(F.when(here, F.col(bin_))).alias(f"__at{i}"), F.max(F.when(here, rest - F.col("before"))).alias(f"__r{i}"),
                F.max(F.when(here, F.col("v"))).alias(f"__v{i}")]
    return bins.groupBy(key).agg(*out, *(F.first(w).alias(w) for w in weights))


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, wanted: tuple[Quantile, ...]) -> DataFrame:
    """Exact quantiles of `column` per group of `keys`."""
    values = df.where(col(column).isNotNull()).select(*map(col, keys), col(column).cast("double").alias("v"))
    counted = values.groupBy(*map(col, keys), "v").agg(F.count(F.lit(1)).alias("n"))
    return counted_quantiles(counted, keys, wanted)
