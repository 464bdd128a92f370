"""Tables that change without being rewritten.

A version is a short list of parts. A part is a folder of written rows with their ids, a map from the
table's columns to the stored ones, and the ids taken out, as bit maps of 64 ids a row. So an
insert writes its rows as a new part; a delete writes bit maps, an update bit maps and the changed rows; a
column that is added without a value, renamed or dropped changes the map alone. Versions are never
changed: who reads one keeps it until `unused` folders are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.plans.paging import BLOCK_SHIFT, ROW_ID, WrittenRows, write_rows
from tallygrid.session import new_folder
from tallygrid.types import col

_PART = "__part"
_WORD = 6  # an id's word is the id without its last six bits


@dataclass(frozen=True)
class Part:
    rows: WrittenRows
    stored: dict[str, str | None]    # column -> stored column; None where the part has no value
    gone: str | None = None          # folder of (word, bits)
    live: tuple[tuple[int, int], ...] | None = None   # live rows per block of ids, where some are gone

    @property
    def row_count(self) -> int:
        return sum(n for _, n in self.live) if self.live is not None else self.rows.row_count


@dataclass(frozen=True)
class TableVersion:
    """A table's rows at one time."""

    spark: SparkSession
    schema: T.StructType
    parts: tuple[Part, ...]
    folders: frozenset[str] = field(default_factory=frozenset)   # all that earlier versions have written

    @classmethod
    def of(cls, rows: WrittenRows | None, schema: T.StructType, spark: SparkSession) -> "TableVersion":
        parts = (Part(rows, {c: c for c in schema.names}),) if rows else ()
        return cls(spark, schema, parts, frozenset(p.rows.path for p in parts))

    @property
    def row_count(self) -> int:
        return sum(p.row_count for p in self.parts)

    def _rows(self, part: Part) -> DataFrame:
        """A part's live rows with their ids, under the table's names and types."""
        found = self.spark.read.parquet(part.rows.path)
        if part.gone:
            gone = self.spark.read.schema("word bigint, bits bigint").parquet(part.gone).select(
                F.col("word").alias("__word"), F.col("bits").alias("__bits"))
            at = (F.col(ROW_ID).bitwiseAND((1 << _WORD) - 1)).cast("int")
            taken = F.getbit(F.coalesce("__bits", F.lit(0).cast("bigint")), at) == 1
            found = found.join(gone, F.shiftright(ROW_ID, _WORD) == F.col("__word"), "left").where(~taken)
        shown = [
            (col(part.stored[f.name]) if part.stored.get(f.name) else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return found.select(*shown, ROW_ID)

    def with_ids(self) -> DataFrame:
        parts = [self._rows(p).withColumn(_PART, F.lit(i)) for i, p in enumerate(self.parts)]
        if not parts:
            return self.spark.createDataFrame([], self.schema).select("*", F.lit(0).cast("bigint").alias(ROW_ID), F.lit(0).alias(_PART))
        return reduce(DataFrame.unionAll, parts)

    def frame(self) -> DataFrame:
        return self.with_ids().select(*map(col, self.schema.names))

    def page(self, limit: int, offset: int) -> DataFrame:
        """Rows `offset` to `offset + limit`: parts in the order they were written, rows in that of their ids."""
        out, skipped = [], 0
        for i, part in enumerate(self.parts):
            n = part.row_count
            first, last = max(0, offset - skipped), min(n, offset + limit - skipped)
            skipped += n
            if first < last:
                out.append(self._part_page(part, last - first, first).withColumn(_PART, F.lit(i)))
        if not out:
            return self.frame().limit(0)
        return reduce(DataFrame.unionAll, out).orderBy(_PART, ROW_ID).select(*map(col, self.schema.names))

    def _part_page(self, part: Part, limit: int, offset: int) -> DataFrame:
        sizes = part.live if part.live is not None else part.rows.partitions
        skipped, wanted, first = 0, [], 0
        for start, n in sizes:
            if skipped + n > offset and skipped < offset + limit:
                first = first if wanted else offset - skipped
                wanted.append(start)
            skipped += n
        span = 1 << (part.rows.shift if part.live is None else BLOCK_SHIFT)
        rows = self._rows(part).where((F.col(ROW_ID) >= wanted[0]) & (F.col(ROW_ID) < wanted[-1] + span))
        if part.gone is None and part.rows.dense:  # the ids of the page are known
            before = sum(n for start, n in sizes if start < wanted[-1])
            rows = rows.where((F.col(ROW_ID) >= wanted[0] + first) & (F.col(ROW_ID) < wanted[-1] + offset + limit - before))
            return rows.orderBy(ROW_ID).limit(limit)
        return rows.orderBy(ROW_ID).offset(first).limit(limit)

    # changes -----------------------------------------------------------------

    def _next(self, parts: tuple[Part, ...], schema: T.StructType | None = None) -> "TableVersion":
        used = {f for p in parts for f in (p.rows.path, p.gone) if f}
        return replace(self, parts=parts, schema=schema or self.schema, folders=self.folders | used)

    def insert(self, rows: DataFrame) -> "TableVersion":
        """`rows`, of this table's columns, as one more part; a column only they have becomes the table's."""
        kept = T.StructType([*self.schema.fields, *(f for f in rows.schema.fields if f.name not in self.schema.names)])
        written = write_rows(rows, "table")
        if not written.row_count:
            return self._next(self.parts, kept)
        return self._next((*self.parts, Part(written, {c: c for c in rows.columns})), kept)

    def _without(self, hit: DataFrame) -> tuple[Part, ...]:
        """The parts without the rows `hit (__part, __row_id)`."""
        folder = new_folder(self.spark, "gone")
        word, bit = F.shiftright(ROW_ID, _WORD).alias("word"), F.expr(f"shiftleft(1L, cast({ROW_ID} & {(1 << _WORD) - 1} as int))")
        hit.groupBy(_PART, word).agg(F.bit_or(bit).alias("bits")).write.partitionBy(_PART).parquet(folder)
        touched = {r[0] for r in self.spark.read.parquet(folder).select(_PART).distinct().collect()} if self._any(folder) else set()
        parts = []
        for i, part in enumerate(self.parts):
            if i not in touched:
                parts.append(part)
                continue
            own = f"{folder}/{_PART}={i}"
            if part.gone:
                before = self.spark.read.schema("word bigint, bits bigint").parquet(part.gone)
                now = self.spark.read.schema("word bigint, bits bigint").parquet(own)
                own = new_folder(self.spark, "gone")
                before.unionAll(now).groupBy("word").agg(F.bit_or("bits").alias("bits")).write.parquet(own)
            lost = {r.b << BLOCK_SHIFT: r.n for r in self.spark.read.parquet(own).groupBy(F.shiftright("word", BLOCK_SHIFT - _WORD).alias("b")).agg(
                F.sum(F.bit_count("bits")).alias("n")).collect()}
            live = tuple((start, n - lost.get(start, 0)) for start, n in part.rows.blocks)
            parts.append(replace(part, gone=own, live=live))
        return tuple(p for p in parts if p.row_count)

    def _any(self, folder: str) -> bool:
        return not self.spark.read.schema("word bigint, bits bigint").parquet(folder).isEmpty()

    def delete(self, where: Column | None) -> "TableVersion":
        if where is None:
            return self._next(())
        return self._next(self._without(self.with_ids().where(F.coalesce(where, F.lit(False))).select(_PART, ROW_ID)))

    def update(self, changed, where: Column | None) -> "TableVersion":
        """`changed(rows)` gives the new values of the rows for which `where` is true; they stand at the end."""
        hit = self.with_ids()
        if where is not None:
            hit = hit.where(F.coalesce(where, F.lit(False)))
        # the new values are written before the old rows go, both from one version
        rows = write_rows(changed(hit.select(*map(col, self.schema.names))), "table")
        if not rows.row_count:
            return self
        left = self._without(hit.select(_PART, ROW_ID)) if where is not None else ()
        return self._next((*left, Part(rows, {c: c for c in self.schema.names})))

    def add_column(self, name: str, data_type: str) -> "TableVersion":
        """A column of NULL; no data is written."""
        schema = T.StructType([*self.schema.fields, T.StructField(name, T._parse_datatype_string(data_type))])
        return self._next(tuple(replace(p, stored={**p.stored, name: None}) for p in self.parts), schema)

    def rename_column(self, old: str, new: str) -> "TableVersion":
        schema = T.StructType([T.StructField(new, f.dataType) if f.name == old else f for f in self.schema.fields])
        return self._next(tuple(replace(p, stored={new if k == old else k: v for k, v in p.stored.items()}) for p in self.parts), schema)

    def drop_column(self, name: str) -> "TableVersion":
        schema = T.StructType([f for f in self.schema.fields if f.name != name])
        return self._next(tuple(replace(p, stored={k: v for k, v in p.stored.items() if k != name}) for p in self.parts), schema)

    def rewritten(self, rows: DataFrame) -> "TableVersion":
        """The table as one part of `rows`."""
        written = write_rows(rows, "table")
        parts = (Part(written, {c: c for c in rows.columns}),) if written.row_count else ()
        return self._next(parts, rows.schema)

    def unused(self) -> set[str]:
        """Folders of earlier versions that this one does not read."""
        return set(self.folders) - {f for p in self.parts for f in (p.rows.path, p.gone) if f}
