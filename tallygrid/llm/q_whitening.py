"""Query op11: all embeddings, whitened on their leading components."""

from pyspark.sql import functions as F

from tallygrid.llm.chebyshev_whitening import whitening
from tallygrid.llm.registry import query
from tallygrid.llm.shared import table


@query("op11_chebyshev_whitening")
def op11(spark, sf_dir):
    rows = whitening(table(spark, sf_dir, "embeddings"))
    # null where the exact number has more than 64 bits
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))
