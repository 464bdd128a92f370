"""Query op7: documents that hold items of the benchmark."""

from pyspark.sql import functions as F

from tallygrid.llm.decontamination import contaminated, split_item
from tallygrid.llm.registry import query
from tallygrid.llm.shared import table


def benchmark_items(spark, sf_dir):
    question, answer = split_item(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", question.alias("question"), answer.alias("answer"))


@query("op7_bm25_decontamination")
def op7(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), benchmark_items(spark, sf_dir))
