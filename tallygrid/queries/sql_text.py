"""SQL as users of embedded engines write it, run through `Workbench.execute`'s own reading of it.

The same text goes to the other engine wherever it has the function; else the text it would take
for it stands beside.
"""

from __future__ import annotations

from tallygrid.functions.scalar_sql import register_functions
from tallygrid.operators.query import parse
from tallygrid.queries.registry import query, table

# name: (tables, text, text for the other engine if it differs)
_TEXTS: dict[str, tuple[str, str, str | None]] = {
    "total": (
        "lineitem", "SELECT l_returnflag, ROUND(TOTAL(l_tax), 2) AS v, TOTAL(NULLIF(l_tax, l_tax)) AS none FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(SUM(l_tax), 2) AS v, 0.0::DOUBLE AS none FROM lineitem GROUP BY l_returnflag"),
    "group_concat": (
        "nation", "SELECT n_regionkey, GROUP_CONCAT(n_name) AS names, GROUP_CONCAT(DISTINCT n_regionkey, ';') AS keys FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names, CAST(n_regionkey AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey"),
    "quantile": (
        "lineitem", "SELECT l_returnflag, CAST(QUANTILE(l_quantity, 0.3) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag", None),
    "quantile_cont": (
        "lineitem", "SELECT l_returnflag, ROUND(QUANTILE_CONT(l_extendedprice, 0.3), 4) AS q FROM lineitem GROUP BY l_returnflag", None),
    "percentile": (
        "lineitem", "SELECT l_returnflag, ROUND(PERCENTILE(l_extendedprice, 0.9), 4) AS q FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(QUANTILE_CONT(l_extendedprice, 0.9), 4) AS q FROM lineitem GROUP BY l_returnflag"),
    "list": (
        "nation", "SELECT n_regionkey, SIZE(LIST(NULLIF(n_name, 'CHINA'))) AS n, SIZE(LIST(n_name) FILTER (WHERE n_nationkey > 9)) AS m "
        "FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, LEN(LIST(NULLIF(n_name, 'CHINA')))::INT AS n, COALESCE(LEN(LIST(n_name) FILTER (WHERE n_nationkey > 9)), 0)::INT AS m "
        "FROM nation GROUP BY n_regionkey"),
    "log": ("part", "SELECT p_partkey, ROUND(LOG(p_retailprice), 9) AS l, ROUND(LOG(2, p_size), 9) AS l2 FROM part", None),
    "concat": (
        "nation", "SELECT n_nationkey, CONCAT(n_name, NULL, '-', n_regionkey) AS c, CONCAT(NULLIF(n_name, n_name)) AS empty FROM nation", None),
    "divide": (
        "part", "SELECT p_partkey, ROUND(p_size / 7, 9) AS d, p_size / (p_size - p_size) AS none, p_size % 0 AS rest, MOD(p_size, p_size - p_size) AS m FROM part",
        "SELECT p_partkey, ROUND(p_size / 7, 9) AS d, CAST(NULL AS DOUBLE) AS none, CAST(NULL AS INT) AS rest, CAST(NULL AS INT) AS m FROM part"),
    "iif": (
        "orders", "SELECT o_orderkey, IIF(o_totalprice > 100000, 'high', IIF(o_totalprice > 10000, 'middle', 'low')) AS band FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'middle' ELSE 'low' END AS band FROM orders"),
    "time": ("events", "SELECT event_id, TIME(ts) AS t FROM events", "SELECT event_id, STRFTIME(ts, '%H:%M:%S') AS t FROM events"),
    "datetime": (
        "events", "SELECT event_id, YEAR(DATETIME('2024-02-03 04:05:06')) AS y, CAST(DATE(ts) AS STRING) AS d, STRFTIME(ts, '%Y-%m') AS m FROM events",
        "SELECT event_id, 2024 AS y, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, STRFTIME(ts, '%Y-%m') AS m FROM events"),
    "quote": (
        "nation", "SELECT n_nationkey, QUOTE(REPLACE(n_name, 'A', '''')) AS q FROM nation",
        "SELECT n_nationkey, '''' || REPLACE(REPLACE(n_name, 'A', ''''), '''', '''''') || '''' AS q FROM nation"),
    "nulls_last": (
        "orders", """WITH o AS (SELECT o_orderkey, NULLIF(MONTH(o_orderdate), 3) AS m FROM orders)
            SELECT o_orderkey, m, RANK() OVER (ORDER BY m) AS up, RANK() OVER w AS down FROM o WINDOW w AS (ORDER BY m DESC) ORDER BY m, o_orderkey LIMIT 12000""",
        """WITH o AS (SELECT o_orderkey, NULLIF(MONTH(o_orderdate), 3) AS m FROM orders)
            SELECT o_orderkey, m, RANK() OVER (ORDER BY m NULLS LAST) AS up, RANK() OVER (ORDER BY m DESC NULLS LAST) AS down FROM o
            ORDER BY m NULLS LAST, o_orderkey LIMIT 12000"""),
    "subqueries": (
        "orders lineitem", """SELECT o_orderpriority, TOTAL(o_totalprice / 1000) AS t, 'LOG(1) / 0' AS text /* CONCAT(1) */ FROM orders
            WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE LOG(l_extendedprice) > 4 AND l_quantity / 2 > (SELECT AVG(l_quantity) / 4 FROM lineitem))
            GROUP BY o_orderpriority HAVING TOTAL(o_totalprice) > 0 -- LIST(x)""",
        """SELECT o_orderpriority, SUM(o_totalprice / 1000) AS t, 'LOG(1) / 0' AS text FROM orders
            WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE LOG(l_extendedprice) > 4 AND l_quantity / 2 > (SELECT AVG(l_quantity) / 4 FROM lineitem))
            GROUP BY o_orderpriority"""),
}


def _register(name: str, tables: str, text: str, other: str | None) -> None:
    @query(f"sql_text_{name}", other or text)
    def build(spark, folder):
        register_functions(spark)
        for t in tables.split():
            table(spark, folder, t).createOrReplaceTempView(t)
        return parse(spark, text)


for _name, (_tables, _text, _other) in _TEXTS.items():
    _register(_name, _tables, _text, _other)
