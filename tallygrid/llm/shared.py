"""Written intermediates, id filters and table access of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.session import map_arrow, new_folder  # noqa: F401
from tallygrid.sources.files import delete_folder

#: Bits of an id filter: 1 MB, whatever the number of ids. Beyond some ten million ids it lets
#: more and more rows through; what it lets through is decided by a join.
FILTER_BITS = 1 << 23
_BITMAP_BITS = 32768

#: Folders of intermediates by what they belong to.
_written: dict[str, list[str]] = {}
_scope = ""


def give_back_memory() -> None:
    """What a task's Python worker has freed goes back to the system; allocators keep it for themselves otherwise,
    while the worker waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def temporary_folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted by `release`."""
    folder = new_folder(spark, label)
    _written.setdefault(_scope, []).append(folder)
    return folder


def written(frame: DataFrame, label: str) -> DataFrame:
    """The rows of `frame`, computed once and kept as Parquet in the shared folder."""
    spark = frame.sparkSession
    folder = temporary_folder(spark, label)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def release(spark: SparkSession, scope: str | None = None) -> None:
    """Delete the intermediates of all results so far, or of one scope; call it once these are stored."""
    for name in [scope] if scope is not None else list(_written):
        for folder in _written.pop(name, []):
            delete_folder(spark, folder)


@contextmanager
def intermediates(spark: SparkSession, scope: str) -> Iterator[None]:
    """What is written in the block belongs to `scope`, whose earlier intermediates go.

    The driver lets go of the plans of earlier blocks too, and Spark's cleaner of their broadcasts and shuffles:
    both wait for a collection, which a driver with a heap to spare may put off for a long time.
    """
    global _scope
    release(spark, scope)
    gc.collect()
    spark._jvm.System.gc()
    before, _scope = _scope, scope
    try:
        yield
    finally:
        _scope = before


def slot(column: Column) -> Column:
    """The bit of an id filter that stands for a value."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_filter(frame: DataFrame, column: str) -> bytes:
    """A bit map of fixed size with the slots of all values of a column."""
    at = frame.select(slot(F.col(column)).alias("at"))
    parts = (
        at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
        .collect()  # at most FILTER_BITS / 32768 rows of 4 KB
    )
    out = bytearray(FILTER_BITS // 8)
    size = _BITMAP_BITS // 8
    for bucket, bits in parts:
        out[(bucket - 1) * size : bucket * size] = bits
    return bytes(out)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose doc_id is not among `ids (doc_id)`; null is an id too.

    The ids are written first, so Spark knows their size and ships them only where that is small.
    """
    gone = written(ids.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
