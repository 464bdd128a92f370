"""Run registered queries and their SQL side by side and report differences.

    python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallygrid import build_session  # noqa: E402
from tallygrid.queries import ORACLES, QUERIES, TABLES  # noqa: E402


def comparable(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows in one order."""
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda c: c.map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else repr_of(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True) if len(text.columns) else text


def repr_of(value) -> str:
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    kinds = [
        f"{c}: {spark_frame[c].dtype} / {sql_frame[c].dtype}"
        for c in spark_frame.columns
        # a nullable whole number comes as a float from one engine
        if spark_frame[c].dtype.kind != sql_frame[c].dtype.kind and len(spark_frame) and not sql_frame[c].isna().any()
    ]
    a, b = comparable(spark_frame), comparable(sql_frame)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        at = wrong.idxmax()
        cells = [f"{c}: {a.at[at, c]} / {b.at[at, c]}" for c in a.columns if a.at[at, c] != b.at[at, c]]
        return f"{int(wrong.sum())} rows differ, first: " + "; ".join(cells)[:400]
    return "types only: " + ", ".join(kinds) if kinds else None


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                  "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name in args or QUERIES:
        started = time.time()
        try:
            found = QUERIES[name](spark, folder).toPandas()
            seconds = time.time() - started
            if name not in ORACLES:
                print(f"ROWS  {name} {len(found)} {seconds:.2f}s", flush=True)
                continue
            started = time.time()
            expected = db.execute(ORACLES[name]).df()
            problem = difference(found, expected)
            print(f"{'OK   ' if problem is None else 'DIFF '} {name} {len(found)} rows {seconds:.2f}s "
                  f"(sql {time.time() - started:.2f}s) {problem or ''}", flush=True)
            bad += problem is not None
        except Exception as error:  # report and go on with the next
            bad += 1
            print(f"FAIL  {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
