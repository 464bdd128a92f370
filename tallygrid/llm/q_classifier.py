"""Query op9: quality scores of all documents."""

from tallygrid.llm.kernel_classifier import quality_scores
from tallygrid.llm.registry import query
from tallygrid.llm.shared import table


@query("op9_fourier_quality_classifier")
def op9(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, threshold=0.3)
