"""Split windows, grouped quantiles and pages against Spark's plain forms."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallygrid.operators.columns import COLUMN_QUERIES
from tallygrid.plans import paging
from tallygrid.plans.counted_quantiles import grouped_quantiles
from tallygrid.plans.order_statistics import DISCRETE, Quantile
from tallygrid.plans.split_window import Order, SplitWindow
from tallygrid.session import setting


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many partitions as large ones would have."""
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        yield


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, some under NULL, many equal order values."""
    return spark.sql(
        """SELECT id, CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 17 = 0 THEN NULL ELSE concat('k', id % 40) END AS k,
                  id * 7919 % 500 AS o, CASE WHEN id % 5 <> 0 THEN id % 13 END AS v FROM range(6000)"""
    ).cache()


def test_split_window_equals_plain_window(skewed):
    plain = Window.partitionBy("k").orderBy("o", "id")
    by_value = Window.partitionBy("k").orderBy("o")
    expected = skewed.select(
        "id", F.row_number().over(plain).alias("rn"), F.rank().over(by_value).alias("rk"),
        F.dense_rank().over(by_value).alias("dr"), F.lag("v").over(plain).alias("lag"),
        F.lead("v").over(plain).alias("lead"),
        F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("sum"),
    )
    both = (
        SplitWindow(["k"], ["o"], ["id"]).row_number("rn").lag("lag", F.col("v")).lead("lead", F.col("v"))
        .running_sum("sum", F.col("v")).rank("rk").dense_rank("dr").apply(skewed)
    )
    got = {r.id: r for r in both.collect()}
    assert len(got) == 6000
    for row in expected.collect():
        mine = got[row.id]
        assert (row.rn, row.rk, row.dr, row.lag, row.lead) == (mine.rn, mine.rk, mine.dr, mine.lag, mine["lead"])
        assert (row["sum"] or 0) == (mine["sum"] or 0)


def test_grouped_quantiles_equal_built_in(skewed):
    wanted = (
        Quantile("q10", 0.1), Quantile("median", 0.5), Quantile("top", 1.0), Quantile("disc", 0.75, DISCRETE)
    )
    got = {r.k: r for r in grouped_quantiles(skewed, ["k"], "o", wanted).collect()}
    expected = skewed.groupBy("k").agg(
        F.percentile("o", 0.1).alias("q10"), F.percentile("o", 0.5).alias("median"), F.max("o").alias("top"),
        F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY o)").alias("disc"),
    ).collect()
    assert len(got) == len(expected)
    for row in expected:
        mine = got[row.k]
        assert (mine.q10, mine.median, mine.top, mine.disc) == pytest.approx((row.q10, row.median, row.top, row.disc))


def test_grouped_quantiles_of_no_rows(skewed):
    assert grouped_quantiles(skewed.where("false"), ["k"], "o", (Quantile("m", 0.5),)).collect() == []


def test_pages_add_up_to_the_sorted_table(skewed):
    order = [F.col("o").desc(), F.col("id")]
    whole = [r.id for r in skewed.orderBy(*order).collect()]
    pages = paging.page_count(6000, 1000)
    got = [r.id for n in range(1, pages + 1) for r in paging.page_number(skewed, n, 1000, order).collect()]
    assert got == whole and paging.page_count(0) == 1 and paging.page_count(101, 100) == 2


def test_pages_of_a_query_and_of_written_rows(spark, skewed):
    order = [F.col("o"), F.col("id")]
    whole = [r.id for r in skewed.orderBy(*order).collect()]
    stored = paging.write_rows(skewed.orderBy(*order))
    assert stored.dense
    for limit, offset in ((10, 95), (500, 1234), (100, 5950), (5, 6000), (0, 200)):
        for page in (paging.page(skewed, limit, offset, order), stored.page(limit, offset)):
            assert [r.id for r in page.collect()] == whole[offset:offset + limit], (limit, offset)


def test_stored_page_prunes_the_scan(spark, skewed):
    stored = paging.write_rows(skewed.repartitionByRange(8, "id").sortWithinPartitions("id"))
    assert stored.row_count == 6000 and len(stored.partitions) > 1
    plan = stored.page(10, 3000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__row_id" in plan and "LessThan(__row_id" in plan
    assert [r.id for r in stored.page(10, 3000).collect()] == list(range(3000, 3010))
    assert paging.ROW_ID not in stored.frame().columns


@pytest.mark.parametrize("kind", sorted(COLUMN_QUERIES))
def test_column_queries(skewed, kind):
    found = COLUMN_QUERIES[kind](skewed, "v").collect()
    values = [r.v for r in found]
    if kind.startswith("order"):
        present = [v for v in values if v is not None]
        assert len(values) == 6000 and values == present + [None] * 1200
        assert present == sorted(present, reverse=kind.endswith("desc"))
    elif kind == "distinct":
        assert values == [*range(13), None]
    elif kind in ("count", "group_by"):
        assert values[0] is None and [r["count"] for r in found] == sorted((r["count"] for r in found), reverse=True)
    else:
        assert len(found) == (1200 if kind == "filter_null" else 4800)


@pytest.mark.parametrize("bits", [22, 6])
def test_quantiles_by_digits(spark, monkeypatch, bits):
    """Exact whatever the width of a digit; at 6 bits no bin list is longer than 64 rows."""
    import random

    from tallygrid.plans import counted_quantiles as cq
    from tallygrid.plans.order_statistics import DISCRETE, LINEAR, ORDINAL, Quantile

    monkeypatch.setattr(cq, "BITS", bits)
    random.seed(7)
    kinds = {
        "unique": [random.gauss(0, 1e6) for _ in range(3000)], "near": [1000 + k * 1e-9 for k in range(500)], "ties": [1.0, 1.0, 2.0] * 50 + [-3.0],
        "one": [5e-324], "wide": [10.0**k for k in range(-300, 300, 7)] + [-(10.0**k) for k in range(-300, 300, 11)], "zero": [0.0, -0.0, 0.0, None],
        "inf": [float("inf"), float("-inf"), 1.0], "none": [None, None],
    }
    frame = spark.createDataFrame([(k, v) for k, vs in kinds.items() for v in vs], "k string, v double")
    wanted = (Quantile("a", 0.5, LINEAR), Quantile("b", 0.25, ORDINAL), Quantile("c", 0.9, DISCRETE), Quantile("d", 0.0, LINEAR), Quantile("e", 1.0, LINEAR))
    got = {r.k: r for r in cq.grouped_quantiles(frame, ["k"], "v", wanted).collect()}
    assert "none" not in got and len(got) == len(kinds) - 1
    for k, vs in kinds.items():
        s = sorted(v for v in vs if v is not None)
        if s:
            low, share = int(0.5 * (len(s) - 1)), 0.5 * (len(s) - 1) % 1
            middle = s[low] if not share else s[low] * (1 - share) + s[min(low + 1, len(s) - 1)] * share
            assert got[k].a == pytest.approx(middle, rel=1e-12), k
            assert (got[k].b, got[k].d, got[k].e) == (s[min(len(s) // 4, len(s) - 1)], s[0], s[-1]), k
            assert got[k].c == s[max(-(-9 * len(s) // 10), 1) - 1], k


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_first", [False, True])
def test_directions_null_order_and_frames(spark, skewed, monkeypatch, descending, nulls_first):
    """Few order values, NULL among them, so peers lie over many partitions; blocks of nine rows."""
    from tallygrid.plans import split_window

    monkeypatch.setattr(split_window, "BLOCK", 9)
    rows = skewed.withColumn("o", F.when(F.col("o") % 7 != 0, F.floor(F.col("o") / 100)))
    order = Order("o", descending, nulls_first)
    by_value = Window.partitionBy("k").orderBy(order.of("o"))
    plain = Window.partitionBy("k").orderBy(order.of("o"), F.col("id").desc())
    whole = Window.partitionBy("k")
    expected = rows.select(
        "id", F.row_number().over(plain).alias("rn"), F.rank().over(by_value).alias("rk"), F.dense_rank().over(by_value).alias("dr"),
        F.lag("v").over(plain).alias("lag"), F.lead("v", 3).over(plain).alias("lead3"), F.sum("v").over(plain.rowsBetween(-2, 0)).alias("last3"),
        F.max("v").over(plain.rowsBetween(-4, 5)).alias("near"), F.count("v").over(plain.rowsBetween(1, 2)).alias("next2"),
        F.sum("v").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("n"))
    window = (
        SplitWindow(["k"], [order], [Order("id", True)]).row_number("rn").rank("rk").dense_rank("dr").lag("lag", F.col("v")).lead("lead3", F.col("v"), 3)
        .rows("last3", F.sum, F.col("v"), -2, 0).rows("near", F.max, F.col("v"), -4, 5).rows("next2", F.count, F.col("v"), 1, 2)
        .total("total", F.col("v")).count("n"))
    got = window.apply(rows)
    assert got.columns == [*rows.columns, "rn", "rk", "dr", "lag", "total", "n", "lead3", "last3", "near", "next2"]
    assert {tuple(r) for r in got.select(*expected.columns).collect()} == {tuple(r) for r in expected.collect()} and got.count() == 6000


def test_one_order_value_is_split(spark):
    """A group of one day: its rows lie in many partitions."""
    rows = spark.range(20000).select("id", F.lit("x").alias("k"), F.lit(1).alias("day"))
    found = SplitWindow(["k"], ["day"], ["id"]).row_number("rn").rank("rk").dense_rank("dr").apply(rows)
    assert found.where("rn = id + 1 and rk = 1 and dr = 1").count() == 20000
    assert len(found.inputFiles()) >= 4


def test_split_window_of_no_rows(skewed):
    assert SplitWindow(["k"], ["o"]).rank("rk").rows("s", F.sum, F.col("v"), -1, 0).apply(skewed.where("false")).collect() == []
