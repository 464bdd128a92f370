"""Query op1: quality rules by robust distance over all documents."""

from tallygrid.llm.registry import query
from tallygrid.llm.robust_outliers import robust_quality
from tallygrid.llm.shared import table


@query("op1_robust_outliers")
def op1(spark, sf_dir):
    return robust_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
