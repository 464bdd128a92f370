"""Query op6: language model scores of all documents."""

from tallygrid.llm.hidden_markov import hidden_markov_scores
from tallygrid.llm.registry import query
from tallygrid.llm.shared import table


@query("op6_hidden_markov_scores")
def op6(spark, sf_dir):
    return hidden_markov_scores(table(spark, sf_dir, "documents"), folds=10)
