"""Profiles against plain Python on small tables, NULLs, odd types and hot values included."""

import math
import statistics
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import adhoc_profile, distribution, profile
from tallygrid.plans.cells import ValueCounts
from tallygrid.plans.order_statistics import ORDINAL, Quantile
from tallygrid.types import category, text_to_double


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.sql(
        """SELECT id, CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id END AS hot,
                  CASE WHEN id % 5 <> 0 THEN sqrt(id) END AS root, CASE WHEN id % 2 = 0 THEN concat('v', id % 20) END AS text,
                  CAST(NULL AS STRING) AS nothing, CAST(NULL AS DOUBLE) AS no_number, '' AS blank,
                  id % 2 = 0 AS flag, CAST(id % 9 AS DECIMAL(10,2)) AS money, array(id % 4, 1) AS listed,
                  DATE_ADD(DATE'2024-01-01', CAST(id % 30 AS INT)) AS day, named_struct('a', id % 3) AS pair,
                  map('k', id % 2) AS lookup, CAST('x' AS BINARY) AS bytes
           FROM range(1000)"""
    )


def test_profile_columns(spark, mixed):
    found = {r.column_name: r for r in profile.profile_columns(mixed).collect()}
    values = {c: [r[0] for r in mixed.select(c).collect()] for c in ("id", "hot", "root", "text", "flag", "money", "day")}
    for name, column in values.items():
        present = [v for v in column if v is not None]
        row = found[name]
        assert row.total_count == 1000 and row.null_count == 1000 - len(present)
        assert row.unique_count == len(set(present))
        assert row.null_percentage == round(row.null_count / 10, 2)
        ranked = sorted(Counter(present).items(), key=lambda e: (-e[1], e[0]))[:10]
        assert [t["count"] for t in row.top_values] == [n for _, n in ranked]
    for name in ("id", "hot", "root", "money"):
        numbers = pd.Series([float(v) for v in values[name] if v is not None])
        row = found[name]
        expected = [numbers.min(), numbers.max(), numbers.mean(), numbers.median(), numbers.std(),
                    numbers.quantile(0.25), numbers.quantile(0.75)]
        got = [row.min_value, row.max_value, row.mean_value, row.median_value, row.std_value, row.q1_value, row.q3_value]
        assert got == pytest.approx(expected, abs=1e-4)
    lengths = [len(v) for v in values["text"] if v is not None]
    assert (found["text"].min_length, found["text"].max_length) == (min(lengths), max(lengths))
    assert found["text"].avg_length == round(sum(lengths) / len(lengths), 2)
    assert found["blank"].avg_length is None and found["blank"].max_length == 0
    assert found["nothing"].top_values == [] and found["nothing"].unique_count == 0
    assert found["no_number"].median_value is None and found["no_number"].null_percentage == 100.0
    assert found["listed"].unique_count == 4 and found["listed"].category == "other"
    assert found["pair"].unique_count == 3 and found["lookup"].unique_count == 2
    assert found["hot"].top_values[0].asDict() == {"value": "7", "count": Counter(values["hot"])[7]}
    assert [found[c].position for c in mixed.columns] == list(range(len(mixed.columns)))


def test_empty_table(spark, mixed):
    for row in profile.profile_table(mixed.where("1 = 0"), "none").collect():
        assert row.row_count == row.total_count == row.unique_count == row.memory_usage == 0
        assert row.null_percentage == row.unique_percentage == 0.0
        assert row.top_values == [] and row.median_value is None


def test_single_row_and_constant(spark):
    row = profile.profile_columns(spark.sql("SELECT 7 AS x")).first()
    assert (row.min_value, row.median_value, row.q3_value, row.std_value) == (7.0, 7.0, 7.0, None)
    assert [tuple(r) for r in distribution.histogram(spark.sql("SELECT 7 AS x FROM range(5)"), "x").collect()] == [(0, 7.0, 5)]


def test_nan_and_infinity_are_not_reported(spark):
    df = spark.sql("SELECT double(v) AS x FROM VALUES ('nan'), ('1'), ('2'), ('inf') AS t(v)")
    row = profile.profile_columns(df).first()
    assert row.max_value is None and row.mean_value is None and row.min_value == 1.0
    assert [(r.bin, r.n) for r in distribution.histogram(df, "x", 2).collect()] == [(0, 1), (2, 1)]


def test_wide_table_is_profiled_in_several_passes(spark):
    wide = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c {i}`") for i in range(120)])
    found = profile.profile_columns(wide).orderBy("position").collect()
    assert [r.unique_count for r in found] == [min(i + 1, 20) for i in range(120)]
    assert [r.column_name for r in found] == wide.columns


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], ["a.b `c`", "x\"y'z"])
    assert [r.null_count for r in profile.profile_columns(df).collect()] == [0, 1]
    assert distribution.frequency(df, "x\"y'z").count() == 2
    with pytest.raises(ValueError):
        profile.profile_column(df, "none")


@pytest.mark.parametrize("value", [
    "id", "id % 7", "7", "CASE WHEN id % 3 = 0 THEN 500 ELSE id END", "CASE WHEN id < 2500 THEN 1 ELSE 2 END",
    "exp(id / 10)", "CASE WHEN id % 4 = 0 THEN double('nan') ELSE id END", "CASE WHEN id % 2 = 0 THEN -id END",
    "CAST(NULL AS DOUBLE)", "CASE WHEN id = 3 THEN 5 END", "CASE WHEN id % 3 = 0 THEN double('inf') ELSE id END",
])
def test_counts_give_exact_quantiles(spark, value):
    df = spark.range(5000).select(F.expr(value).cast("double").alias("x"))
    wanted = (Quantile("a", 0.5), Quantile("b", 0.25), Quantile("c", 0.99), Quantile("d", 0.0), Quantile("e", 1.0))
    built_in = df.agg(F.percentile("x", [q.p for q in wanted])).first()[0] or [None] * len(wanted)
    by_counts = ValueCounts(df).quantiles(wanted).first() or [0] + [None] * len(wanted)
    assert [str(v) for v in by_counts[1:]] == [str(v) for v in built_in]


def test_profiles_without_a_fitting_column(spark):
    text, numbers = spark.createDataFrame([("a",)], "t string"), spark.range(3)
    assert profile.profile_numeric(text).collect() == [] and profile.numeric_summary(text).collect() == []
    assert profile.profile_string(numbers).collect() == []
    assert profile.profile_numeric(text).columns == profile.profile_numeric(numbers).columns


def test_ordinal_quartiles_follow_sorted_positions(spark):
    wanted = (Quantile("q1", 0.25, ORDINAL), Quantile("q3", 0.75, ORDINAL))
    for n in (1, 2, 3, 4, 5, 7, 8, 41, 200):
        df = spark.range(n).select((F.col("id") * 37 % 101).cast("double").alias("x"))
        ordered = sorted(i * 37 % 101 for i in range(n))
        row = ValueCounts(df).quantiles(wanted).first()
        assert (row.q1, row.q3) == (ordered[n // 4], ordered[3 * n // 4]), n


def test_text_to_double(spark):
    cases = {
        "1": 1.0, " 1 ": 1.0, "1_000": 1000.0, "1d": None, "1f": None, "0x1p3": None, ".5": 0.5, "5.": 5.0, "+1e5": 1e5,
        "nan": "nan", "inf": "inf", "-Infinity": "-inf", "": None, "1__0": None, "_1": None, "1,5": None, "e5": None,
        "12a": None, "1e": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for fast in (False, True):
        got = df.select(text_to_double(F.col("t"), fast)).collect()
        for (text, expected), (value,) in zip(cases.items(), got):
            assert (value is None and expected is None) or str(value) == str(float(expected)), (text, value)


def test_lenient_profile_matches_plain_python(spark):
    column = [None, "", "NULL", "n/a", "3", "1", "2", "2", "10", " 4 ", "1_000", "x", "7.5", "-1"] * 3 + ["99"]
    row = adhoc_profile.profile_lenient(spark.createDataFrame([(v,) for v in column], "v string"), "v").first()
    present = [v for v in column if v not in (None, "", "NULL")]
    numbers = sorted(float(v) for v in present if v not in ("n/a", "x"))
    assert row.total_rows == len(column) and row.missing_count == len(column) - len(present)
    assert row.missing_percentage == pytest.approx(row.missing_count / len(column) * 100)
    assert row.unique_count == len(set(present)) and row.is_numeric and row.dtype == "numeric"
    n = len(numbers)
    assert (row.q1_value, row.q3_value) == (numbers[n // 4], numbers[3 * n // 4])
    assert row.median_value == statistics.median(numbers) and row.std_value == pytest.approx(statistics.stdev(numbers))
    top = adhoc_profile.lenient_top_values(spark.createDataFrame([(v,) for v in column], "v string"), "v").collect()
    assert top[0].asDict() == {"value": "2", "n": 6} and len(top) == 10


def test_lenient_profile_of_words_and_of_nothing(spark):
    words = adhoc_profile.profile_lenient(spark.createDataFrame([("a",), ("1",)], "v string"), "v").first()
    assert not words.is_numeric and words.min_value is None and words.dtype == "text"
    one = adhoc_profile.profile_lenient(spark.createDataFrame([("5",)], "v string"), "v").first()
    assert one.is_numeric and one.median_value == 5.0 and one.std_value is None and one.q1_value is None
    none = adhoc_profile.profile_lenient(spark.createDataFrame([], "v string"), "v").first()
    assert none.total_rows == 0 and none.missing_percentage == 0.0 and not none.is_numeric


@pytest.mark.parametrize("expression,dtype", [
    ("CAST(id AS STRING)", "numeric"), ("id % 2 = 0", "numeric"), ("CAST(NULL AS STRING)", "unknown"),
    ("CASE WHEN id = 5 THEN 'x' ELSE CAST(id AS STRING) END", "text"), ("TIMESTAMP_NTZ'2024-01-01 00:00:00'", "text"),
    ("DATE'2024-01-01'", "text"), ("array(id)", "text"), ("id / 3", "numeric"),
])
def test_kind_of_a_query_column(spark, expression, dtype):
    df = spark.sql(f"SELECT {expression} AS v FROM range(10)")
    row = adhoc_profile.profile_sql_column(df, "v").first()
    assert row.dtype == dtype and row.is_numeric == (dtype == "numeric")
    assert (row.median_value is not None) == row.is_numeric
    assert sum(r.n for r in adhoc_profile.top_values(df, "v").collect()) == row.total_rows - row.missing_count


def test_missing_values(spark, mixed):
    report = {r.column_name: r for r in profile.missing_report(mixed).collect()}
    summary = profile.missing_summary(mixed).first()
    assert summary.total_missing == sum(r.null_count for r in report.values())
    assert summary.total_cells == 1000 * len(mixed.columns)
    assert not report["id"].has_missing and report["text"].null_percentage == 50.0
    ranked = [(r.column_name, r.severity) for r in profile.missing_ranked(mixed).collect()]
    assert ranked == [("no_number", "error"), ("nothing", "error"), ("text", "warning"), ("root", "success"), ("hot", "success")]


def test_histogram_covers_every_value(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    for bins in (1, 7, 20):
        found = distribution.histogram(df, "l_extendedprice", bins).collect()
        assert sum(r.n for r in found) == df.count() and max(r.bin for r in found) == bins
    assert distribution.histogram(df.where("false"), "l_tax").collect() == []


def test_distribution_picks_by_type(spark, mixed):
    assert distribution.distribution(mixed, "root").columns == ["bin", "bin_start", "n"]
    counts = {r.value: r.n for r in distribution.distribution(mixed, "text").collect()}
    assert counts["NULL"] == 500 and sum(counts.values()) == 1000
    with pytest.raises(ValueError):
        distribution.distribution(mixed, "none")


def test_categories(mixed):
    kinds = {f.name: category(f.dataType) for f in mixed.schema}
    assert kinds["id"] == "integer" and kinds["money"] == "float" and kinds["day"] == "datetime"
    assert kinds["flag"] == "boolean" and kinds["pair"] == kinds["listed"] == kinds["lookup"] == kinds["bytes"] == "other"
    summary = {r.category: r.column_count for r in profile.dtype_summary(mixed).collect()}
    assert sum(summary.values()) == len(mixed.columns) and not math.isnan(summary["integer"])


def test_profiles_of_several_result_columns(spark):
    from tallygrid.operators.adhoc_profile import profile_sql_column, profile_sql_columns

    df = spark.sql("""SELECT id, CASE WHEN id % 4 <> 0 THEN id / 2 END AS half, concat('t', id % 5) AS t, CAST(id % 3 AS STRING) AS digits, id % 2 = 0 AS b,
        date'2024-01-01' AS d, NULL AS nothing, CAST('x' AS BINARY) AS raw, CASE WHEN id % 2 = 0 THEN -0.0D ELSE 0.0D END AS zero, array(id) AS a FROM range(50)""")
    together = {r.column_name: r for r in profile_sql_columns(df, df.columns).collect()}
    for c in df.columns:
        one = profile_sql_column(df, c).first()
        assert {k: round(v, 9) if isinstance(v, float) else v for k, v in one.asDict().items()} == {
            k: round(v, 9) if isinstance(v, float) else v for k, v in together[c].asDict().items()}, c
    assert {r.dtype for r in profile_sql_columns(df.where("false"), ["id", "t"]).collect()} == {"unknown"}
