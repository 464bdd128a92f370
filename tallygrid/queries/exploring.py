"""Scans, pages, catalog, views, ready-made column queries and data changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import catalog, changes, columns, query as run
from tallygrid.plans import paging
from tallygrid.queries.profiles import GAPS_ORACLE, orders_with_gaps
from tallygrid.queries.registry import TABLES, query, table, union_all
from tallygrid.workbench import Workbench


def _tables(spark, folder):
    return {name: table(spark, folder, name) for name in TABLES}


# pages -------------------------------------------------------------------------

@query("table_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 5000")
def table_page(spark, folder):
    stored = paging.write_rows(table(spark, folder, "orders").orderBy("o_orderkey"), "table")
    return stored.page(1000, 5000)


PAGED = """
    SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS spent
    FROM {orders} GROUP BY o_custkey
"""


@query("sql_page", PAGED.format(orders="orders") + "ORDER BY spent DESC, o_custkey LIMIT 100 OFFSET 200")
def sql_page(spark, folder):
    result = spark.sql(PAGED, orders=table(spark, folder, "orders"))
    return paging.page_number(result, 3, 100, [F.col("spent").desc(), F.col("o_custkey")])


@query("sql_total", f"SELECT COUNT(*) AS total_rows FROM ({PAGED.format(orders='orders')})")
def sql_total(spark, folder):
    result = spark.sql(PAGED, orders=table(spark, folder, "orders"))
    return result.agg(F.count(F.lit(1)).alias("total_rows"))


@query("project_column", "SELECT c_mktsegment FROM customer")
def project_column(spark, folder):
    return columns.project_column(table(spark, folder, "customer"), "c_mktsegment")


# catalog -----------------------------------------------------------------------

_COUNTS = union_all([f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES])
_CATEGORY = """CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN column_type = 'DOUBLE' THEN 'float'
    WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'other' END"""
_COLUMNS = union_all([
    f"SELECT '{t}' AS table_name, column_name, '{t}.' || column_name AS path, {_CATEGORY} AS category "
    f"FROM (DESCRIBE {t})" for t in TABLES
])


@query(
    "catalog_tables",
    f"SELECT c.table_name, c.row_count, w.column_count FROM ({_COUNTS}) AS c JOIN "
    f"(SELECT table_name, COUNT(*) AS column_count FROM ({_COLUMNS}) GROUP BY table_name) AS w USING (table_name)",
)
def catalog_tables(spark, folder):
    return catalog.catalog_tables(spark, _tables(spark, folder))


@query(
    "catalog_columns",
    f"SELECT d.*, c.row_count FROM ({_COLUMNS}) AS d JOIN ({_COUNTS}) AS c USING (table_name)",
)
def catalog_columns(spark, folder):
    tables = _tables(spark, folder)
    described = catalog.catalog_columns(spark, tables).select("table_name", "column_name", "path", "category")
    return described.join(catalog.row_counts(tables), "table_name")


@query("catalog_search", f"SELECT * FROM ({_COUNTS}) WHERE table_name LIKE '%on%'")
def catalog_search(spark, folder):
    return catalog.search(catalog.row_counts(_tables(spark, folder)), "ON")


@query(
    "view_query",
    """SELECT o_orderpriority, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean_price FROM orders
       WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""",
)
def view_query(spark, folder):
    bench = Workbench(spark)
    table(spark, folder, "orders").createOrReplaceTempView("stored_orders")
    # the second builds on the first, whatever the order they are listed in
    bench.restore_views({
        "finished_by_priority": "SELECT o_orderpriority, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean_price "
                                "FROM finished GROUP BY o_orderpriority",
        "finished": "SELECT * FROM stored_orders WHERE o_orderstatus = 'F';",
    })
    return run.parse(spark, "SELECT * FROM finished_by_priority;")


# ready-made column queries -----------------------------------------------------

@query("sort_asc", GAPS_ORACLE + "SELECT * FROM t ORDER BY o_totalprice ASC NULLS LAST")
def sort_asc(spark, folder):
    return columns.sort_asc(orders_with_gaps(spark, folder), "o_totalprice")


@query("sort_desc", GAPS_ORACLE + "SELECT * FROM t ORDER BY o_orderstatus DESC NULLS LAST")
def sort_desc(spark, folder):
    return columns.sort_desc(orders_with_gaps(spark, folder), "o_orderstatus")


@query("distinct_values", GAPS_ORACLE + "SELECT DISTINCT o_orderdate FROM t ORDER BY o_orderdate NULLS LAST")
def distinct_values(spark, folder):
    return columns.distinct_values(orders_with_gaps(spark, folder), "o_orderdate")


@query("value_counts", GAPS_ORACLE + """SELECT o_orderpriority, COUNT(*) AS count FROM t GROUP BY o_orderpriority
       ORDER BY count DESC""")
def value_counts(spark, folder):
    return columns.value_counts(orders_with_gaps(spark, folder), "o_orderpriority")


@query("group_statistics", "SELECT l_shipdate, COUNT(*) AS count FROM lineitem GROUP BY l_shipdate")
def group_statistics(spark, folder):
    return columns.group_statistics(table(spark, folder, "lineitem"), "l_shipdate")


@query("filter_null", GAPS_ORACLE + "SELECT * FROM t WHERE o_orderpriority IS NULL")
def filter_null(spark, folder):
    return columns.filter_null(orders_with_gaps(spark, folder), "o_orderpriority")


@query("filter_not_null", GAPS_ORACLE + "SELECT * FROM t WHERE o_totalprice IS NOT NULL")
def filter_not_null(spark, folder):
    return columns.filter_not_null(orders_with_gaps(spark, folder), "o_totalprice")


@query("top_n", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def top_n(spark, folder):
    return columns.top_n(
        table(spark, folder, "lineitem"), 25,
        F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
    )


# data and column changes -------------------------------------------------------

@query(
    "dml_insert",
    """SELECT * FROM customer UNION ALL
       SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS VARCHAR) FROM supplier""",
)
def dml_insert(spark, folder):
    rows = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
    )
    return changes.insert(table(spark, folder, "customer"), rows)


@query(
    "dml_update",
    GAPS_ORACLE + """SELECT o_orderkey, o_custkey, o_orderstatus,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
        o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM t""",
)
def dml_update(spark, folder):
    return changes.update(
        orders_with_gaps(spark, folder),
        {"o_totalprice": F.col("o_totalprice") * 2, "o_orderpriority": F.lit("done")},
        F.col("o_orderstatus") == "F",
    )


@query("dml_delete", GAPS_ORACLE + "SELECT * FROM t WHERE NOT COALESCE(o_totalprice > 100000, FALSE)")
def dml_delete(spark, folder):
    return changes.delete(orders_with_gaps(spark, folder), F.col("o_totalprice") > 100000)


@query(
    "ddl_ctas",
    """SELECT o_custkey, SUM(o_totalprice) > 2000000 AS big_spender, COUNT(*) AS n FROM orders GROUP BY o_custkey""",
)
def ddl_ctas(spark, folder):
    bench = Workbench(spark)
    made = spark.sql(
        "SELECT o_custkey, SUM(o_totalprice) > 2000000 AS big_spender, COUNT(*) AS n FROM {orders} GROUP BY o_custkey",
        orders=table(spark, folder, "orders"),
    )
    bench.create_table("spenders", made)
    return bench.table("spenders")


@query(
    "ddl_alter",
    """SELECT p_partkey, p_name AS p_title, p_brand, p_type, p_size, CAST(NULL AS VARCHAR) AS p_note FROM part""",
)
def ddl_alter(spark, folder):
    part = table(spark, folder, "part")
    renamed = changes.rename_column(part, "p_name", "p_title")
    return changes.add_column(changes.drop_column(renamed, "p_retailprice"), "p_note", "string")


@query(
    "dml_statements",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2 ELSE o_totalprice END AS price,
              CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS status, CAST(NULL AS VARCHAR) AS note
       FROM orders WHERE o_orderkey % 3 <> 0
       UNION ALL SELECT -c_custkey, c_acctbal, c_mktsegment, c_name FROM customer WHERE c_acctbal > 0""",
)
def dml_statements(spark, folder):
    # five statements on one table; the first alone writes all rows
    bench = Workbench(spark)
    bench.create_table("changed_orders", table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")))
    table(spark, folder, "customer").createOrReplaceTempView("new_customers")
    for statement in (
        "DELETE FROM changed_orders WHERE o_orderkey % 3 = 0",
        "UPDATE changed_orders SET price = price / 2, status = 'closed' WHERE status = 'F'",
        "ALTER TABLE changed_orders DROP COLUMN o_custkey",
        "ALTER TABLE changed_orders ADD COLUMN note STRING",
        "INSERT INTO changed_orders SELECT -c_custkey, c_acctbal, c_mktsegment, c_name FROM new_customers WHERE c_acctbal > 0",
    ):
        page = bench.execute(statement)
        if page.error:
            raise ValueError(page.error)
    return bench.table("changed_orders")


@query(
    "dml_page",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 ORDER BY o_orderkey LIMIT 700 OFFSET 9000""",
)
def dml_page(spark, folder):
    # a page of a table that rows were taken out of, from their own places
    bench = Workbench(spark)
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")
    bench.create_table("thinned_orders", rows)
    bench.delete("thinned_orders", F.col("o_orderkey") % 5 == 0)
    return bench.table_info("thinned_orders").rows.page(700, 9000)
