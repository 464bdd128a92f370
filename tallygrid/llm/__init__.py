"""Operators of a training-data pipeline, and their queries."""

from tallygrid.llm import q_classifier, q_decontamination, q_filters, q_hidden_markov, q_jaccard, q_license, q_mixing, q_outliers, q_recompression, q_token_counts, q_tokens, q_warc, q_whitening  # noqa: F401
from tallygrid.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
