"""Audit of filters in every order: what each removes, finds removed, and costs.

A document's failures are a mask of five bits, so each part of the corpus is a count per
mask. Where in an order a mask is removed depends on the order's beginning only: letters
not in the mask, then one that is. In lexicographic order of the 120 permutations (their
Lehmer ranks) all that share a beginning of k letters are an interval of (5 - k)! ranks. So each mask and
beginning adds its counts at the interval's first rank and takes them off after its
last; one running sum over the ranks gives every order's totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from tallygrid.llm import words as W
from tallygrid.llm.shared import map_arrow, written

FILTERS = "ABCDE"
_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
#: Bounds of the filters, as whole percents.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
_MARKS = b"#$%&*|"


def _own_failures(docs: DataFrame, label: str) -> DataFrame:
    """`(doc_id, part, mask, print)`: failures of A to D, and the SHA-256 of the whole text."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    marks, upper = np.zeros(256, bool), np.zeros(256, bool)
    marks[list(_MARKS)] = True
    upper[65:91] = True

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).fill_null("")
            offsets, _ = W.buffers(text)
            for part in W.words(text):
                masks, prints = [], []
                for r in range(part.last - part.first):
                    begin, end = int(offsets[part.first + r]), int(offsets[part.first + r + 1])
                    own = part.data[begin:end]
                    per_byte = np.bincount(own, minlength=256)
                    points = len(own) - int(per_byte[0x80:0xC0].sum())
                    hashes = part.hashes[part.at[r] : part.at[r + 1]]
                    fails = (
                        len(hashes) < LEAST_WORDS, 100 * len(np.unique(hashes)) < LEAST_DISTINCT * len(hashes),
                        100 * int(per_byte[upper].sum()) > MOST_UPPER * points, bool(per_byte[marks].any()))
                    masks.append(sum(_BIT[f] for f, failed in zip(FILTERS, fails) if failed))
                    prints.append(hashlib.sha256(own.data).digest())
                n = part.last - part.first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, n), batch.column(1).slice(part.first, n), pa.array(masks, pa.int32()), pa.array(prints, pa.binary())],
                    ["doc_id", "part", "mask", "print"])

    schema = StructType([
        rows.schema["doc_id"], StructField("part", StringType()), StructField("mask", IntegerType()), StructField("print", BinaryType())])
    return written(map_arrow(rows, judge, schema), label)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(part, mask, n, good, toxic)`: documents of each part by the filters they fail.

    Every copy of a text but those with the smallest doc_id fails E. So the rows that pass it are found by an
    equal join on text and doc_id, which no group of copies makes uneven, and the others are the rest.
    """
    own = _own_failures(docs, "failures")
    marked = labels.groupBy(F.col("doc_id").alias("__doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = own.join(marked, own["doc_id"] == marked["__doc_id"], "left").select(
        "doc_id", "part", "mask", "print", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    rows = written(rows, "marked")
    first = rows.groupBy("print").agg(F.min("doc_id").alias("first")).where("first is not null")
    less = ("n", "good", "toxic")
    counts = (F.count("mask").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    alone = rows.join(
        first.withColumnRenamed("print", "__print"), (rows["print"] == F.col("__print")) & (rows["doc_id"] == F.col("first")), "left_semi")
    # no doc_id is smaller than null
    passed = alone.unionAll(rows.where("doc_id is null")).groupBy("part", "mask").agg(*counts)
    every = rows.groupBy("part", "mask").agg(*counts)
    copies = every.unionAll(passed.select("part", "mask", *((-F.col(c)).alias(c) for c in less))).groupBy("part", "mask").agg(
        *(F.sum(c).alias(c) for c in less)).withColumn("mask", F.col("mask").bitwiseOR(_BIT["E"]))
    return passed.unionAll(copies).where("n > 0")


def _rank(beginning: tuple[str, ...]) -> int:
    """The Lehmer rank of the first permutation with this beginning."""
    left, rank = list(FILTERS), 0
    for f in beginning:
        rank = rank + left.index(f) * factorial(len(left) - 1)
        left.remove(f)
    return rank


def _intervals(spark: SparkSession) -> DataFrame:
    """`(mask, step, rank, sign)`: where a mask's removal at a step begins (1) and has ended (-1)."""
    rows = []
    for mask in range(1, 1 << len(FILTERS)):
        failing = [f for f in FILTERS if mask & _BIT[f]]
        passing = [f for f in FILTERS if f not in failing]
        for k in range(len(passing) + 1):
            for before in permutations(passing, k):
                for f in failing:
                    start = _rank((*before, f))
                    rows += [(mask, k + 1, start, 1), (mask, k + 1, start + factorial(len(FILTERS) - k - 1), -1)]
    return spark.createDataFrame(rows, "mask int, step int, rank int, sign int")


def _orders(spark: SparkSession) -> DataFrame:
    """`(rank, step, filter_order, bit)` of the 120 permutations."""
    rows = [
        (rank, step + 1, "".join(order), _BIT[f]) for rank, order in enumerate(permutations(FILTERS)) for step, f in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, step int, filter_order string, bit int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter of each order removes, per part; a row per part, order and step.

    Reads `docs (doc_id, text, lang)` and `labels (doc_id, quality, toxic)`, all whole texts; other columns are
    ignored. A null text is an empty one (it fails A, and E where it is not the first), a null lang is the part
    "". Rows that repeat a doc_id are documents each, and none is another's copy. A null doc_id is no copy and
    makes none. A document counts as good or toxic where any label row of its doc_id says so. An empty table has no parts and gives no rows.
    """
    spark = docs.sparkSession
    masks = written(mask_counts(docs, labels), "masks")  # at most 32 rows a part
    intervals, orders = F.broadcast(_intervals(spark)), F.broadcast(_orders(spark))
    counts = ("n", "good", "toxic")
    changes = masks.join(intervals, "mask").groupBy("part", "step", "rank").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in counts))
    totals = masks.groupBy("part").agg(F.sum("n").alias("all"), *(
        F.sum(F.when(F.col("mask").bitwiseAND(bit) > 0, F.col("n")).otherwise(0)).alias(f"fails{f}") for f, bit in _BIT.items()), *(
        F.sum(F.when(F.col("mask") == bit, F.col("n")).otherwise(0)).alias(f"only{f}") for f, bit in _BIT.items()))
    # 600 rows a part
    grid = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(len(FILTERS)) - 1)))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))).join(orders, ["rank", "step"])
    filled = grid.join(changes, ["part", "step", "rank"], "left")
    along = Window.partitionBy("part", "step").orderBy("rank")
    removed = filled.select(
        "part", "rank", "step", "filter_order", "bit", "all",
        *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in counts),
        F.coalesce(*(F.when(F.col("bit") == bit, F.col(f"fails{f}")) for f, bit in _BIT.items())).alias("fails"),
        F.coalesce(*(F.when(F.col("bit") == bit, F.col(f"only{f}")) for f, bit in _BIT.items())).alias("only"))
    here = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return removed.select(
        "part", "filter_order", "step", (F.col("all") - F.sum("n").over(here)).alias("kept"), F.col("n").alias("removed"),
        # who fails the filter is removed by it or was removed before
        (F.col("fails") - F.col("n")).alias("redundant"), F.col("only").alias("unique_fails"), F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "bit")).alias("shapley"))
