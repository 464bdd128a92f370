"""All registered queries."""

from tallygrid.queries import constructs, csv_files, exploring, function_calls, profiles, sql_text  # noqa: F401
from tallygrid.queries.registry import ORACLES, QUERIES, TABLES

__all__ = ["ORACLES", "QUERIES", "TABLES"]
