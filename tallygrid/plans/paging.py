"""Pages of a result.

`page` is one query of its own: every task keeps `offset + limit` rows. A result that is
to be paged through is written once with a running row id (`write_rows`), and a page then
reads only the row groups that hold its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.session import new_folder
from tallygrid.types import col

ROW_ID = "__row_id"
# monotonically_increasing_id keeps the partition number above this bit
_PARTITION_SHIFT = 33
# where ids have gaps, rows are counted per this many ids: a page then reads the row groups of these only
BLOCK_SHIFT = 16


def with_row_id(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


@dataclass
class WrittenRows:
    """Rows written with a row id, and how many each written partition holds.

    `partitions` is one `(first id, rows)` pair per write task, or per block of ids where these have gaps;
    `shift` tells which, and `dense` that there is none. `columns` are the ones shown, by default
    all but the row id.
    """

    spark: SparkSession
    path: str
    partitions: list[tuple[int, int]]
    columns: list[str] | None = None
    dense: bool = False
    shift: int = _PARTITION_SHIFT

    @classmethod
    def open(cls, spark: SparkSession, path: str, columns: list[str] | None = None) -> "WrittenRows":
        part = F.shiftright(F.col(ROW_ID), _PARTITION_SHIFT)
        counted = spark.read.parquet(path).groupBy(part.alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("low"), F.max(ROW_ID).alias("high")).collect()
        dense = all(r["high"] - r["low"] + 1 == r["n"] and r["low"] == r["p"] << _PARTITION_SHIFT for r in counted)
        if dense:
            return cls(spark, path, sorted((r["p"] << _PARTITION_SHIFT, r["n"]) for r in counted), columns, True)
        return cls(spark, path, block_counts(spark.read.parquet(path)), columns, False, BLOCK_SHIFT)

    @property
    def blocks(self) -> list[tuple[int, int]]:
        """`(first id, rows)` of every block of ids."""
        if not self.dense:
            return self.partitions
        size = 1 << BLOCK_SHIFT
        return [(first + k, min(size, n - k)) for first, n in self.partitions for k in range(0, n, size)]

    @property
    def row_count(self) -> int:
        return sum(n for _, n in self.partitions)

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.select(*map(col, self.columns)) if self.columns else rows.drop(ROW_ID)

    def frame(self) -> DataFrame:
        return self._shown(self.spark.read.parquet(self.path))

    def page(self, limit: int, offset: int) -> DataFrame:
        """Rows `offset` to `offset + limit` in written order."""
        skipped, ranges, first_skip = 0, [], 0
        for first, n in self.partitions:
            if skipped + n > offset and skipped < offset + limit:
                if not ranges:
                    first_skip = offset - skipped
                ranges.append(first)
            skipped += n
        rows = self.spark.read.parquet(self.path)
        if not ranges or limit <= 0:
            return self._shown(rows).limit(0)
        if self.dense:  # the ids of the page are known
            before = sum(n for first, n in self.partitions if first < ranges[-1])
            lower, upper = ranges[0] + first_skip, ranges[-1] + offset + limit - before
            return self._shown(rows.where((F.col(ROW_ID) >= lower) & (F.col(ROW_ID) < upper)).orderBy(ROW_ID).limit(limit))
        upper = ranges[-1] + (1 << self.shift)
        # partitions, and blocks, are contiguous, so one range of ids is what the scan prunes by
        wanted = rows.where((F.col(ROW_ID) >= ranges[0]) & (F.col(ROW_ID) < upper))
        return self._shown(wanted.orderBy(ROW_ID).offset(first_skip).limit(limit))


def block_counts(rows: DataFrame) -> list[tuple[int, int]]:
    """`(first id, rows)` of every block of ids that has rows."""
    block = F.shiftright(F.col(ROW_ID), BLOCK_SHIFT)
    counted = rows.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row to 65,536 ids
    return sorted((r["b"] << BLOCK_SHIFT, r["n"]) for r in counted)


def write_rows(df: DataFrame, label: str = "result") -> WrittenRows:
    """Write an ordered result to the shared folder."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    with_row_id(df).write.parquet(path)
    return WrittenRows.open(spark, path)


def page(
    df: DataFrame, limit: int, offset: int = 0, order_by: list[Column] | None = None
) -> DataFrame:
    """One page of `df`, in `order_by` order where one is given."""
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def page_number(df: DataFrame, number: int, size: int = 100, order_by: list[Column] | None = None) -> DataFrame:
    """Page `number` (from 1) of pages of `size` rows."""
    return page(df, size, (number - 1) * size, order_by)


def page_count(total_rows: int, size: int = 100) -> int:
    return max(1, -(-total_rows // size))
