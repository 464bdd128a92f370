"""The registry: tables, views, queries, profiles and changes through one object."""

import pytest
from pyspark.sql import functions as F

from tallygrid import Workbench
from tallygrid.functions import columns as fn
from tallygrid.operators import changes


@pytest.fixture
def bench(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("id,city,price\n" + "".join(f"{i},{'AB'[i % 2]},{i * 1.5}\n" for i in range(2500)) + "bad\n")
    made = Workbench(spark)
    made.load_csv(str(path))
    yield made
    made.clear_all()


def test_table_info_and_rejects(bench):
    info = bench.table_info("sales")
    assert (info.row_count, info.encoding) == (2500, "UTF-8") and info.file_size > 0
    assert [c["dtype"] for c in info.columns] == ["bigint", "string", "double"]
    assert bench.table_info("none") is None
    assert [r.line for r in bench.rejects("sales").collect()] == ["bad"]


def test_pages_of_a_table(bench):
    page = bench.table_data("sales", 100, 2450)
    assert [r[0] for r in page.data] == list(range(2450, 2500)) and page.total_rows == 2500
    assert page.columns == ["id", "city", "price"] and bench.table_data("none").error


def test_queries(bench):
    page = bench.execute("SELECT city, COUNT(*) AS n FROM sales GROUP BY city ORDER BY city;")
    assert page.data == [["A", 1250], ["B", 1250]] and page.total_rows == 2 and page.error is None
    assert bench.execute("SELECT * FROM sales LIMIT 7").total_rows == 7
    limited = bench.execute("SELECT id FROM sales ORDER BY id", 10, 20)
    assert [r[0] for r in limited.data] == list(range(20, 30)) and limited.total_rows == 2500
    assert "TABLE_OR_VIEW_NOT_FOUND" in bench.execute("SELECT * FROM gone").error
    assert bench.execute("SELECT 1 +").error
    assert bench.execute("WITH x AS (SELECT 1 AS a) SELECT * FROM x").data == [[1]]
    assert bench.execute("VALUES (1), (2)").row_count == 2
    assert bench.execute("SET spark.sql.shuffle.partitions=8").error is None
    assert bench.execute("SELECT strftime(TIMESTAMP_NTZ'2024-03-05 07:08:09', '%d.%m.%Y at %H:%M')").data == [
        ["05.03.2024 at 07:08"]
    ]


def test_pages_of_a_query_are_written_once(bench):
    sql = "SELECT id FROM sales ORDER BY id DESC"
    for offset in (0, 1000, 2450, 2499, 2500):
        page = bench.execute(sql, 100, offset)
        assert [r[0] for r in page.data] == list(range(2499 - offset, -1, -1))[:100] and page.total_rows == 2500
    assert len(bench._results) == 1
    bench.delete("sales", F.col("id") >= 1000)
    assert bench._results == {} and bench.execute(sql, 100, 950).total_rows == 1000
    assert bench.execute("SELECT * FROM gone", 100, 950).error


def test_views_follow_their_tables(bench):
    assert bench.save_view("cheap", "SELECT * FROM sales WHERE price < 15;")
    assert not bench.save_view("broken", "SELECT * FROM gone")
    assert bench.restore_views({"top": "SELECT * FROM mid", "mid": "SELECT * FROM cheap", "bad": "SELECT"}) == ["bad"]
    assert bench.execute("SELECT COUNT(*) FROM top").data == [[10]]
    bench.delete("sales", F.col("id") < 5)
    assert bench.execute("SELECT COUNT(*) FROM top").data == [[5]]
    assert set(bench.views()) == {"cheap", "top", "mid"}
    assert [r.name for r in bench.search("CHE").collect()] == ["cheap"] and bench.search("").count() == 4
    bench.delete_view("top")
    assert bench.execute("SELECT * FROM top").error


def test_profile_is_kept_until_the_table_changes(bench):
    first = bench.analyze_table("sales")
    assert bench.analyze_table("sales") is first and bench.analyze_table("sales", force_refresh=True) is not first
    assert {r.column_name: r.unique_count for r in first.collect()}["id"] == 2500
    bench.insert("sales", "VALUES (9999, 'C', 1)")
    after = {r.column_name: r for r in bench.analyze_table("sales").collect()}
    assert after["city"].unique_count == 3 and after["id"].row_count == 2501
    column = bench.analyze_column("sales", "price").first()
    assert column.is_numeric and column.total_rows == 2501
    profiled, top = bench.analyze_column_from_sql("SELECT upper(city) AS c FROM sales", "c")
    assert profiled.first().dtype == "text" and top.count() == 3
    report, summary = bench.missing_report("sales")
    assert report.count() == 3 and summary.first().total_missing == 0
    assert bench.numeric_summary("sales").count() == 2
    assert bench.column_distribution("sales", "city").count() == 3
    with pytest.raises(ValueError):
        bench.analyze_table("gone")


def test_changes_make_new_versions(bench):
    assert bench.update("sales", {"city": F.lit("Z")}, F.col("id") >= 2000).row_count == 2500
    assert bench.execute("SELECT COUNT(*) FROM sales WHERE city = 'Z'").data == [[500]]
    bench.add_column("sales", "note", "string")
    bench.rename_column("sales", "note", "remark")
    assert bench.table("sales").columns == ["id", "city", "price", "remark"]
    assert bench.drop_column("sales", "remark").row_count == 2500
    made = bench.create_table("copy", "SELECT city, SUM(price) AS s FROM sales GROUP BY city")
    assert made.row_count == 3 and bench.columns().where("table_name = 'copy'").count() == 2
    with pytest.raises(ValueError):
        bench.create_table("copy", "SELECT 1 AS x")


def test_tables_made_by_statements(bench, spark, tmp_path):
    name = "made_by_statement"
    made = bench.execute(f"CREATE TABLE {name} USING parquet LOCATION '{tmp_path}/t' AS SELECT city, id FROM sales")
    assert made.error is None and made.columns == []
    assert bench.execute(f"INSERT INTO {name} VALUES ('C', -1)").error is None
    assert bench.table_info(name).row_count == 2501 and name in [t.name for t in bench.tables()]
    assert bench.columns().where(f"table_name = '{name}'").count() == 2 and bench.search(name).count() == 1
    assert [r.row_count for r in bench.analyze_table(name).collect()] == [2501, 2501]
    assert bench.analyze_column(name, "city").first().unique_count == 3
    assert bench.execute(f"DROP TABLE {name}").error is None
    with pytest.raises(ValueError):
        bench.analyze_table(name)


def test_changes_by_statement(bench):
    run = lambda sql: bench.execute(sql).error
    assert run("INSERT INTO sales VALUES (9001, 'X', 1.5), (9002, 'X', NULL);") is None
    assert run("INSERT INTO sales (price, id) SELECT 7, 9003") is None
    assert bench.execute("SELECT id, city, price FROM sales WHERE id > 9000 ORDER BY id").data == [
        [9001, "X", 1.5], [9002, "X", None], [9003, None, 7.0]]
    assert run("UPDATE sales SET city = concat(city, 'Y'), price = price + 1 WHERE id IN (9001, 9002)") is None
    assert bench.execute("SELECT city, price FROM sales WHERE id = 9001").data == [["XY", 2.5]]
    assert run("DELETE FROM sales WHERE id < 2500 AND city LIKE 'A%'") is None
    assert bench.table_info("sales").row_count == 1253
    assert run("ALTER TABLE sales ADD COLUMNS (note STRING, n INT)") is None
    assert run("ALTER TABLE sales RENAME COLUMN note TO remark") is None and run("ALTER TABLE sales DROP COLUMN n") is None
    assert bench.table("sales").columns == ["id", "city", "price", "remark"]
    assert [r.line for r in bench.rejects("sales").collect()] == ["bad"] and bench.table_info("sales").file_size > 0
    assert run("DELETE FROM gone WHERE a = 1") and run("DELETE FROM sales WHERE nothing = 1") and run("INSERT INTO sales VALUES (1)")
    assert run("DROP TABLE sales") is None and bench.table_info("sales") is None and bench.table_data("sales").error
    assert not bench.drop_table("sales")


def test_results_with_repeated_and_untyped_columns(bench):
    page = bench.execute("SELECT id AS a, id AS a, NULL AS b FROM sales ORDER BY id", 2, 0)
    assert page.columns == ["a", "a", "b"] and page.data == [[0, 0, None], [1, 1, None]] and page.total_rows == 2500


def test_unknown_conditions_change_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "a int, b int")
    assert sorted(r.a for r in changes.delete(df, F.col("b") > 6).collect()) == [1, 2]
    assert changes.delete(df).count() == 0
    swapped = changes.update(df, {"a": F.col("b"), "b": F.col("a")}, F.col("b") > 6)
    assert sorted((r.a, r.b or 0) for r in swapped.collect()) == [(1, 0), (2, 5), (9, 3)]
    more = changes.insert(df, spark.sql("SELECT 4L, '7'"), by_position=True)
    assert more.schema == df.schema and more.count() == 4
    with pytest.raises(ValueError):
        changes.insert(df, spark.range(1), by_position=True)
    with pytest.raises(ValueError):
        changes.update(df, {"none": F.lit(1)}).count()


def test_export(bench, spark, tmp_path):
    assert bench.export_csv("sales", str(tmp_path / "t"))
    assert bench.export_csv("SELECT id FROM sales", str(tmp_path / "q"), is_sql=True)
    assert not bench.export_csv("gone", str(tmp_path / "g"))
    bench.save_view("v", "SELECT * FROM sales")
    bench.export_view("v", str(tmp_path / "v"), limit=10)
    assert spark.read.csv(str(tmp_path / "v"), header=True).count() == 10
    assert Workbench(spark).load_csv(str(tmp_path / "t"), "again").row_count == 2500


def test_drop(bench):
    folder = bench.table_info("sales").loaded.folder
    bench.drop_table("sales")
    assert bench.tables() == [] and bench.execute("SELECT * FROM sales").error
    from tallygrid.sources.files import exists
    assert not exists(bench.spark, folder)


def test_date_patterns():
    assert fn.date_pattern("%Y-%m") == "yyyy-MM"
    assert fn.date_pattern("day %d o'clock") == "'day 'dd' o''clock'"
    assert fn.date_pattern("100%%") == "100%" and fn.date_pattern("%d[x]") == "dd'[x]'"
    with pytest.raises(ValueError):
        fn.date_pattern("%Q")


def test_function_meanings(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, "x"), ("b", None, None)], "k string, v int, t string")
    got = {r.k: r for r in df.groupBy("k").agg(
        fn.total(F.col("v")).alias("total"), fn.group_concat(F.col("t")).alias("joined"),
        fn.list_all(F.col("v")).alias("listed"),
    ).collect()}
    assert (got["a"].total, got["a"].joined, got["a"].listed) == (1.0, "x", [1, None])
    assert (got["b"].total, got["b"].joined, got["b"].listed) == (0.0, None, [None])
    row = spark.range(1).select(
        fn.log(F.lit(100.0)).alias("log"), fn.divide(F.lit(1), F.lit(0)).alias("zero"),
        fn.concat(F.lit("a"), F.lit(None), F.lit(1)).alias("joined"), fn.quote(F.lit("it's")).alias("quoted"),
        fn.upper(F.lit("straße")).alias("upper"),
    ).first()
    assert tuple(row) == (2.0, None, "a1", "'it''s'", "STRAẞE")
