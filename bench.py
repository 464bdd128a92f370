"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallygrid import build_session  # noqa: E402
from tallygrid.operators import profile  # noqa: E402
from tallygrid.queries import QUERIES  # noqa: E402
from tallygrid.queries.registry import table  # noqa: E402

HEADLINE = (
    "profile_base", "profile_numeric", "profile_table", "profile_top10", "profile_sql", "profile_lenient",
    "profile_string_documents", "null_summary", "missing_ranked", "numeric_summary", "histogram", "frequency50",
    "csv_roundtrip", "csv_rejects", "sort_desc", "distinct_values", "value_counts", "filter_not_null", "table_page",
    "sql_page", "join_inner", "join_rows", "join_left", "set_intersect", "win_rank", "win_lag_lead", "win_running_sum",
    "agg_basic", "agg_quantile", "agg_count_distinct", "fn_math", "fn_string", "fn_strftime", "sql_recursive",
)
RUNS = 2


def profile_lineitem(spark, folder):
    """The widest table's whole profile."""
    return profile.profile_table(table(spark, folder, "lineitem"), "lineitem")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name, build in [*((n, QUERIES[n]) for n in HEADLINE), ("profile_lineitem", profile_lineitem)]:
        best = None
        for _ in range(RUNS):
            started = time.perf_counter()
            # every column of every row is computed, nothing is fetched
            build(spark, folder).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - started
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total seconds of the headline queries, best of two runs each",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
