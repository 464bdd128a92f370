"""Query op13: tokens of all documents."""

from tallygrid.llm.q_tokens import vocabulary
from tallygrid.llm.registry import query
from tallygrid.llm.shared import table
from tallygrid.llm.token_counts import token_counts


@query("op13_token_counts")
def op13(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
