"""Window functions over groups of any size.

`OVER (PARTITION BY key ORDER BY x)` sends a whole group to one task. When one key holds a
third of all rows that task decides the run time. Here the table is dealt by sampled ranges
of group and order together, so a large group lies in many partitions and each of them follows the
window's order. Ranks, neighbours and sums are taken inside a partition, and what lies before it
is added from one small row per group and partition. Frames of some rows before and after
are taken in blocks of row numbers, each with the rows of its neighbours that it needs. The
results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.session import new_folder
from tallygrid.types import col

#: Row numbers in a block of a frame, if the frame needs no more.
BLOCK = 1 << 18
_B = "__bucket"
# Group and partition as one struct. It is never NULL, so a plain equality joins on
# it, groups with NULL keys included, and the join finds its rows partitioned.
_G = "__group"
_K = "__keys"
_AT = "__at"


@dataclass(frozen=True)
class Order:
    """What to order by, in which direction, and where NULL stands."""

    value: Column | str
    descending: bool = False
    nulls_first: bool = False

    @property
    def column(self) -> Column:
        return col(self.value) if isinstance(self.value, str) else self.value

    def of(self, name: str) -> Column:
        """The same direction for a column of another name."""
        return getattr(F.col(name), f"{'desc' if self.descending else 'asc'}_nulls_{'first' if self.nulls_first else 'last'}")()


def _orders(given: list[Order | str]) -> list[Order]:
    return [o if isinstance(o, Order) else Order(o) for o in given]


@dataclass
class SplitWindow:
    """Window columns over `partition_by`, in the order of `order_by`.

    `order_by` holds names (ascending, NULL last) or `Order`s. Rows that agree in it are peers of the ranks;
    `then_by` orders them for all else, and what is left tied stands in an order that depends on the
    rows' content only.
    """

    partition_by: list[str]
    order_by: list[Order | str]
    then_by: list[Order | str] = field(default_factory=list)
    _values: dict[str, Column] = field(default_factory=dict)
    _inner: dict[str, Column] = field(default_factory=dict)
    _bucket: dict[str, Column] = field(default_factory=dict)
    _outer: dict[str, Column] = field(default_factory=dict)
    _outer_after: dict[str, Column] = field(default_factory=dict)
    _final: dict[str, Column] = field(default_factory=dict)
    _frames: dict[str, tuple[Callable[[Column], Column], str, int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        peers, thens = _orders(self.order_by), _orders(self.then_by)
        self._keys = {f"__o{i}": o.column for i, o in enumerate(peers)} | {f"__t{i}": o.column for i, o in enumerate(thens)}
        self._order = [o.of(f"__o{i}") for i, o in enumerate(peers)]
        self._peers = F.struct(*(f"__o{i}" for i in range(len(peers))))
        self._rows = [*self._order, *(o.of(f"__t{i}") for i, o in enumerate(thens)), F.col("__tie")]
        self._inside = Window.partitionBy(_G).orderBy(*self._rows)
        self._inside_peers = Window.partitionBy(_G).orderBy(*self._order)
        self._across = Window.partitionBy(_K).orderBy(_B)
        self._before = self._across.rowsBetween(Window.unboundedPreceding, -1)

    def _summed(self, name: str, inner: Column, per_bucket: Column) -> "SplitWindow":
        """A value inside the partition plus the partitions' sums before it."""
        self._inner[f"__i_{name}"] = inner
        self._bucket[f"__b_{name}"] = per_bucket
        self._outer[f"__s_{name}"] = F.sum(f"__b_{name}").over(self._before)
        inside, before = F.col(f"__i_{name}"), F.col(f"__s_{name}")
        # a sum over nothing but NULL is NULL on either side
        self._final[name] = F.coalesce(inside + before, inside, before)
        return self

    def row_number(self, name: str) -> "SplitWindow":
        return self._summed(name, F.row_number().over(self._inside).cast("bigint"), F.count(F.lit(1)))

    def _ties(self) -> None:
        """Whether a partition's first peers began in an earlier one, and their rank there."""
        self._inner["__rank"] = F.rank().over(self._inside_peers).cast("bigint")
        self._inner["__dense"] = F.dense_rank().over(self._inside_peers).cast("bigint")
        self._inner["__row"] = F.row_number().over(self._inside)
        self._bucket |= {
            "__n": F.count(F.lit(1)), "__ranks": F.max("__rank"), "__denses": F.max("__dense"),
            "__low": F.min_by(self._peers, "__row"), "__high": F.max_by(self._peers, "__row")}
        self._outer |= {
            "__rows_before": F.coalesce(F.sum("__n").over(self._before), F.lit(0)),
            "__goes_on": F.coalesce(F.col("__low").eqNullSafe(F.lag("__high").over(self._across)), F.lit(False))
            & F.lag(F.lit(True)).over(self._across).isNotNull()}
        goes_on = F.col("__goes_on")
        last = F.when(~(goes_on & (F.col("__ranks") == 1)), F.col("__rows_before") + F.col("__ranks"))
        self._outer_after |= {
            "__rank_before": F.last(last, ignorenulls=True).over(self._before),
            "__dense_before": F.coalesce(F.sum(F.col("__denses") - goes_on.cast("bigint")).over(self._before), F.lit(0)) - goes_on.cast("bigint")}

    def rank(self, name: str) -> "SplitWindow":
        self._ties()
        begun = F.col("__goes_on") & (F.col("__rank") == 1)
        self._final[name] = F.when(begun, F.col("__rank_before")).otherwise(F.col("__rank") + F.col("__rows_before"))
        return self

    def dense_rank(self, name: str) -> "SplitWindow":
        self._ties()
        self._final[name] = F.col("__dense") + F.col("__dense_before")
        return self

    def running_sum(self, name: str, value: Column) -> "SplitWindow":
        frame = self._inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self._values[f"__v_{name}"] = value
        return self._summed(name, F.sum(f"__v_{name}").over(frame), F.sum(f"__v_{name}"))

    def _whole(self, name: str, per_bucket: Column) -> "SplitWindow":
        self._bucket[f"__b_{name}"] = per_bucket
        self._outer[f"__s_{name}"] = F.sum(f"__b_{name}").over(Window.partitionBy(_K))
        self._final[name] = F.col(f"__s_{name}")
        return self

    def total(self, name: str, value: Column) -> "SplitWindow":
        """The sum over the whole group."""
        self._values[f"__v_{name}"] = value
        return self._whole(name, F.sum(f"__v_{name}"))

    def count(self, name: str) -> "SplitWindow":
        """The rows of the whole group."""
        return self._whole(name, F.count(F.lit(1)))

    def _neighbour(self, name: str, value: Column, step: int) -> "SplitWindow":
        if abs(step) != 1:
            return self.rows(name, F.first, value, step, step)
        shift, end = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
        self._values[f"__v_{name}"] = value
        self._inner[f"__i_{name}"] = shift(f"__v_{name}").over(self._inside)
        # a real neighbour inside the partition may well be NULL
        self._inner[f"__e_{name}"] = shift(F.lit(True)).over(self._inside)
        self._inner["__row"] = F.row_number().over(self._inside)
        self._bucket[f"__b_{name}"] = end(f"__v_{name}", "__row")
        self._outer[f"__s_{name}"] = shift(f"__b_{name}").over(self._across)
        self._final[name] = F.when(F.col(f"__e_{name}"), F.col(f"__i_{name}")).otherwise(F.col(f"__s_{name}"))
        return self

    def lag(self, name: str, value: Column, offset: int = 1) -> "SplitWindow":
        return self._neighbour(name, value, -offset)

    def lead(self, name: str, value: Column, offset: int = 1) -> "SplitWindow":
        return self._neighbour(name, value, offset)

    def rows(self, name: str, aggregate: Callable[[Column], Column], value: Column, start: int, end: int) -> "SplitWindow":
        """`aggregate(value)` over ROWS BETWEEN `start` AND `end`, counted from the row; negative ones precede it."""
        self._values[f"__v_{name}"] = value
        self._frames[name] = (aggregate, f"__v_{name}", start, end)
        return self.row_number("__number")

    def apply(self, df: DataFrame) -> DataFrame:
        """`df` with the window columns. The dealt rows are kept in the session's shared folder."""
        tie = F.xxhash64(*map(col, df.columns))
        dealt = df.withColumns({**self._values, **self._keys, "__tie": tie}).repartitionByRange(
            *map(col, self.partition_by), *self._rows).withColumn(_B, F.spark_partition_id())
        folder = new_folder(df.sparkSession, "window")
        dealt.write.parquet(folder)
        inside = df.sparkSession.read.schema(dealt.schema).parquet(folder).withColumn(
            _G, F.struct(F.struct(*map(col, self.partition_by)).alias("k"), F.col(_B).alias("b"))).drop(_B)
        inside = inside.withColumns(self._inner)
        buckets = inside.groupBy(_G).agg(*[c.alias(n) for n, c in self._bucket.items()])
        outer = buckets.withColumns({_K: F.col(f"{_G}.k"), _B: F.col(f"{_G}.b")}).withColumns(self._outer).withColumns(self._outer_after)
        made = [*self._outer, *self._outer_after]
        joined = inside.join(outer.select(F.col(_G).alias("__g"), *made), F.col(_G) == F.col("__g"), "left")
        asked = {n: c for n, c in self._final.items() if n not in self._frames}
        own = [col(c) for c in df.columns]
        if not self._frames:
            return joined.select(*own, *[c.alias(n) for n, c in asked.items()])
        values = [v for _, v, _, _ in self._frames.values()]
        numbered = joined.select(*own, *values, F.col(f"{_G}.k").alias(_K), *[c.alias(n) for n, c in asked.items()])
        return self._framed(numbered).select(*own, *[n for n in asked if n != "__number"], *self._frames)

    def _framed(self, numbered: DataFrame) -> DataFrame:
        before = max(0, *(-start for _, _, start, _ in self._frames.values()))
        after = max(0, *(end for _, _, _, end in self._frames.values()))
        size = max(BLOCK, before, after)
        block, place = F.floor((F.col("__number") - 1) / size), F.pmod(F.col("__number") - 1, F.lit(size))
        targets = F.array(F.struct(block.alias("b"), F.lit(True).alias("own")))
        beside = F.array(
            F.when(place >= size - before, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))),
            F.when((place < after) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("own"))))
        spread = numbered.withColumn(_AT, F.explode(F.concat(targets, F.filter(beside, lambda t: t.isNotNull()))))
        blocks = spread.withColumns({"__block": F.struct(F.col(_K).alias("k"), F.col(f"{_AT}.b").alias("b")), "__own": F.col(f"{_AT}.own")})
        along = Window.partitionBy("__block").orderBy("__number")
        framed = blocks.withColumns({
            name: aggregate(F.col(value)).over(along.rowsBetween(start, end)) for name, (aggregate, value, start, end) in self._frames.items()})
        return framed.where("__own")
