"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, mixing, token ids.

    from corpus_pipeline import run
    digests = run(spark, folder_of_the_tables)

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last give back rows
of `documents` with all their columns; the last gives one row per written document. A
stage's result has to be stored before the next stage begins, which deletes the
intermediates that the result rests on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.decontamination import contaminated
from tallygrid.llm.jaccard_join import jaccard_join
from tallygrid.llm.q_decontamination import benchmark_items
from tallygrid.llm.q_tokens import token_digests
from tallygrid.llm.robust_outliers import kept_by_quality
from tallygrid.llm.shared import intermediates, table, without_ids, written
from tallygrid.llm.source_mixing import mixed, repeated_by_mix


def _stage(build: Callable) -> Callable:
    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with intermediates(spark, "pipeline"):
            return build(spark, docs, sf_dir)
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the robust distance keep.

    Null and empty texts have too few words and go. Rows that repeat a doc_id, or have none, are judged each by
    its own text; null languages and sources are groups like others. An empty table stays empty.
    """
    return kept_by_quality(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 or more connect: the smallest doc_id.

    Of rows that repeat a doc_id the one with the least text stays. Rows without doc_id,
    and texts without words, are no one's duplicates.
    """
    groups = written(jaccard_join(docs, size=5, percent=80), "groups")
    first = without_ids(docs, groups.where("component_id <> doc_id"))
    again = written(
        groups.where("component_id = doc_id").groupBy("doc_id").agg(F.count("doc_id").alias("n")).where("n > 1").select("doc_id"),
        "again")
    once = without_ids(first, again)
    held = F.struct(*(first[f"`{c}`"] for c in first.columns))
    best = first.join(again.withColumnRenamed("doc_id", "__again"), first["doc_id"] == F.col("__again")).groupBy("__again").agg(
        F.min_by(held, F.struct(F.col("text").isNull(), F.col("text"))).alias("row"))
    return once.unionAll(best.select("row.*"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay. If one of the rows that repeat a doc_id, or have none, holds an item, all
    of them go. An empty table stays empty; without items all documents stay.
    """
    return without_ids(docs, contaminated(docs, benchmark_items(spark, sf_dir)))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and are never taken. Null sources are one source. Rows that repeat doc_id
    and text are taken alike, all or none at the cut. An empty table stays empty.
    """
    return repeated_by_mix(docs, mixed(docs))


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, number and checksum of each document's ids in the token table, read back from its files.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are written each, in the order of their
    texts; a null doc_id stands first. An empty table gives no rows.
    """
    return token_digests(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Tokenization, sampling and the covariance steps are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
