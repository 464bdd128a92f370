"""A table as one long frame of typed cells, and the value counts built on it.

Every value of every profiled column becomes one row `(k, <slot>, ...)`: `k` is
the column's position and there is one slot per storage type that occurs, of
which only the column's own can be filled. Spark plans this as a single Expand
over a pruned scan. Grouping by all slots counts each distinct value once per
map task before the shuffle, so a value that fills a third of a column costs one
row per task, and no shuffle key is wider than a cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.plans.counted_quantiles import counted_quantiles
from tallygrid.plans.order_statistics import Quantile
from tallygrid.types import INTEGER, category, col

# plans stay small for wide tables: this many columns share one Expand
COLUMNS_PER_SCAN = 50

_OWN_SLOT = (
    T.DoubleType, T.FloatType, T.StringType, T.BooleanType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _slot(data_type: T.DataType) -> str:
    """The storage type a column's cells are grouped in."""
    if category(data_type) == INTEGER:
        return "bigint"
    if isinstance(data_type, T.DecimalType):
        return data_type.simpleString()
    if isinstance(data_type, _OWN_SLOT):
        return data_type.typeName() if not isinstance(data_type, T.StringType) else "string"
    return "string"


def _slot_column(slot: str) -> str:
    return "v_" + slot.translate(str.maketrans("(,", "__", ")"))


def _storable(name: str, data_type: T.DataType) -> Column:
    value = col(name)
    if isinstance(data_type, T.BinaryType):
        return F.hex(value)
    return value.cast(_slot(data_type))


def cells(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """`(frame, slot column names)`; the frame is `k` plus the slots."""
    position = {name: k for k, name in enumerate(df.columns)}
    fields = [df.schema.fields[position[name]] for name in columns]
    slots = sorted({_slot(f.dataType) for f in fields})
    filled = [_slot_column(s) for s in slots]
    wide, groups = [], []
    for i, f in enumerate(fields):
        names = [f"k{i}"]
        wide.append(F.lit(position[f.name]).alias(f"k{i}"))
        for slot in slots:
            mine = slot == _slot(f.dataType)
            value = _storable(f.name, f.dataType) if mine else F.lit(None).cast(slot)
            names.append(f"{_slot_column(slot)}_{i}")
            wide.append(value.alias(names[-1]))
        groups.append(f"({', '.join(names)}) AS `{i}`")
    long = df.sparkSession.sql(
        f"SELECT k, {', '.join(filled)} FROM {{wide}} UNPIVOT INCLUDE NULLS "
        f"((k, {', '.join(filled)}) FOR source IN ({', '.join(groups)}))",
        wide=df.select(*wide),
    )
    return long, filled


def present(slots: list[str]) -> Column:
    """True for a cell that holds a value."""
    return reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in slots])


def as_text(slots: list[str]) -> Column:
    return F.coalesce(*[F.col(s).cast("string") for s in slots])


class ValueCounts:
    """Exact counts `(k, slots, n)` of every distinct value of the columns."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None):
        names = list(columns if columns is not None else df.columns)
        if not names:  # nothing to count, the same columns
            df, names = df.select(F.lit(None).cast("int").alias("none")).where("false"), ["none"]
        self.parts = []
        for start in range(0, len(names), COLUMNS_PER_SCAN):
            long, slots = cells(df, names[start:start + COLUMNS_PER_SCAN])
            counted = long.groupBy("k", *slots).agg(F.count(F.lit(1)).alias("n"))
            self.parts.append((counted, slots))

    def distinct(self) -> DataFrame:
        """`(k, unique_count)`, NULL not counted.

        Reading `n` keeps this plan's shuffle equal to the one of `top`, so
        that Spark runs it once for both.
        """
        return self._each(
            lambda counted, slots: counted.groupBy("k").agg(
                F.count_if(present(slots) & (F.col("n") > 0)).alias("unique_count")
            )
        )

    def top(self, limit: int, keep_null: bool = False) -> DataFrame:
        """`(k, rank, value, n)`: the most frequent values of every column.

        Equal counts are ordered by the value itself. Spark cuts each map
        task's rows to `limit` per column before the shuffle
        (WindowGroupLimit), so a column of unique keys is never gathered.
        """
        def ranked(counted: DataFrame, slots: list[str]) -> DataFrame:
            # NULL is ranked behind every value instead of being filtered away
            # first: that filter would slip under the shared shuffle
            held = F.lit(True) if keep_null else present(slots)
            order = Window.partitionBy("k").orderBy(
                held.desc(), F.col("n").desc(), *[F.col(s).asc_nulls_last() for s in slots]
            )
            text = as_text(slots)
            return (
                counted.withColumn("rank", F.row_number().over(order))
                .where((F.col("rank") <= limit) & held)
                .select(
                    "k", F.col("rank").cast("bigint").alias("rank"),
                    (F.coalesce(text, F.lit("NULL")) if keep_null else text).alias("value"), "n",
                )
            )
        return self._each(ranked)

    def quantiles(self, wanted: tuple[Quantile, ...]) -> DataFrame:
        """`(k, <quantile names>)` of the numeric columns.

        The groups are columns, which bounds what a round looks for.
        """
        def from_counts(counted: DataFrame, slots: list[str]) -> DataFrame:
            numeric = [s for s in slots if s.startswith(("v_bigint", "v_double", "v_float", "v_decimal"))]
            number = F.coalesce(*[F.col(s).cast("double") for s in numeric], F.lit(None).cast("double"))
            return counted_quantiles(counted.select("k", number.alias("v"), "n"), ["k"], wanted, few_groups=True)
        return self._each(from_counts)

    def _each(self, build) -> DataFrame:
        return reduce(DataFrame.unionByName, [build(c, s) for c, s in self.parts])
