"""Query op4: all documents mixed by source."""

from pyspark.sql import functions as F

from tallygrid.llm.registry import query
from tallygrid.llm.shared import table
from tallygrid.llm.source_mixing import mixed


@query("op4_pareto_source_mixing")
def op4(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
