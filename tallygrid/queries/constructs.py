"""The SQL constructs users write: filters, joins, set operations, windows, CTEs.

Joins count or reduce the larger side per key before they join where the result
allows it, so a key that fills a third of a table meets the join as one row. No
side is broadcast by hint: Spark decides by size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators.columns import not_in
from tallygrid.plans.split_window import Order, SplitWindow
from tallygrid.queries.profiles import GAPS_ORACLE, orders_with_gaps
from tallygrid.session import unbound_recursion
from tallygrid.queries.registry import query, table


@query(
    "sql_project",
    "SELECT l_orderkey AS order_key, l_linenumber AS line, ROUND(l_extendedprice * (1 - l_discount), 4) AS net "
    "FROM lineitem",
)
def sql_project(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
    )


FILTERED = """
    SELECT * FROM {t}
    WHERE (o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 50000 AND 250000 AND TRUE)
       OR (o_orderpriority LIKE '%URGENT' AND NOT o_orderkey < 1000)
       OR (o_orderpriority IS NULL AND o_orderstatus IS NOT NULL AND o_custkey <> 7)
       OR FALSE
"""


@query("sql_filter", GAPS_ORACLE + FILTERED.format(t="t"))
def sql_filter(spark, folder):
    return spark.sql(FILTERED, t=orders_with_gaps(spark, folder))


@query("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def sql_distinct(spark, folder):
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "sql_order",
    GAPS_ORACLE + "SELECT o_orderkey, o_orderpriority, o_totalprice FROM t "
    "ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey",
)
def sql_order(spark, folder):
    return orders_with_gaps(spark, folder).select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        F.col("o_orderpriority").desc_nulls_last(), F.col("o_totalprice").asc_nulls_last(), "o_orderkey"
    )


@query("sql_limit", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 25")
def sql_limit(spark, folder):
    return table(spark, folder, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").offset(25).limit(50)


@query(
    "sql_group_having",
    """SELECT l_suppkey, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity, ROUND(AVG(l_discount), 6) AS discount
       FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > 15000""",
)
def sql_group_having(spark, folder):
    grouped = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return grouped.where(F.col("quantity") > 15000).select(
        "l_suppkey", "n", F.round("quantity", 2).alias("quantity"), F.round("discount", 6).alias("discount"))


def _revenue_per_order(spark, folder):
    """Lines added up per order: one row per key goes into the join."""
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n_lines")
    )


@query(
    "join_inner",
    """SELECT o_orderpriority, o_orderstatus, COUNT(DISTINCT o_orderkey) AS n_orders, COUNT(*) AS n_lines,
              ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem INNER JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority, o_orderstatus""",
)
def join_inner(spark, folder):
    orders = table(spark, folder, "orders")
    lines = _revenue_per_order(spark, folder)
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count_distinct("o_orderkey").alias("n_orders"), F.sum("n_lines").alias("n_lines"), F.round(F.sum("revenue"), 2).alias("revenue")
    )


@query(
    "join_theta",
    """SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS quantity
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 30 DAY
       AND l_extendedprice < o_totalprice GROUP BY l_returnflag""",
)
def join_theta(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    lines = table(spark, folder, "lineitem")
    late = (
        (lines.l_orderkey == orders.o_orderkey)
        & (lines.l_shipdate > orders.o_orderdate + F.expr("INTERVAL 30 DAYS"))
        & (lines.l_extendedprice < orders.o_totalprice)
    )
    return lines.join(orders, late).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity")
    )


@query(
    "join_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_type, s_name FROM lineitem
       JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
)
def join_rows(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_type", "s_name")
    )


def _orders_per_customer(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("largest")
    )


_ORDERED = """(SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM orders GROUP BY o_custkey)"""


@query("join_left", f"SELECT c_custkey, c_name, n, largest FROM customer LEFT JOIN {_ORDERED} ON c_custkey = o_custkey")
def join_left(spark, folder):
    customer, ordered = table(spark, folder, "customer"), _orders_per_customer(spark, folder)
    return customer.join(ordered, customer.c_custkey == ordered.o_custkey, "left").select("c_custkey", "c_name", "n", "largest")


@query(
    "join_right",
    f"SELECT o_custkey, n, c_custkey, c_mktsegment FROM {_ORDERED} RIGHT JOIN customer ON c_custkey = o_custkey",
)
def join_right(spark, folder):
    customer, ordered = table(spark, folder, "customer"), _orders_per_customer(spark, folder)
    return ordered.join(customer, customer.c_custkey == ordered.o_custkey, "right").select(
        "o_custkey", "n", "c_custkey", "c_mktsegment"
    )


@query(
    "join_full",
    """SELECT o_orderdate, l_shipdate, n_orders, n_lines
       FROM (SELECT o_orderdate, COUNT(*) AS n_orders FROM orders GROUP BY o_orderdate)
       FULL OUTER JOIN (SELECT l_shipdate, COUNT(*) AS n_lines FROM lineitem GROUP BY l_shipdate)
       ON o_orderdate = l_shipdate""",
)
def join_full(spark, folder):
    ordered = table(spark, folder, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n_orders"))
    shipped = table(spark, folder, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n_lines"))
    return ordered.join(shipped, ordered.o_orderdate == shipped.l_shipdate, "full")


SHARES = """
    SELECT c_mktsegment, n, ROUND(n * 100.0e0 / total, 4) AS share
    FROM (SELECT c_mktsegment, COUNT(*) AS n FROM {customer} GROUP BY c_mktsegment)
    CROSS JOIN (SELECT COUNT(*) AS total FROM {customer})
"""


@query("join_cross", SHARES.format(customer="customer"))
def join_cross(spark, folder):
    # the right side is an aggregate without groups: always one row
    return spark.sql(SHARES, customer=table(spark, folder, "customer"))


@query(
    "join_semi",
    """SELECT c_custkey, c_name FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)
         AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""",
)
def join_semi(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    buyers = table(spark, folder, "orders").where(F.col("o_totalprice") > 480000).select("o_custkey").distinct()
    near = nation.where(F.col("n_regionkey") < 3)
    return (
        customer.join(buyers, customer.c_custkey == buyers.o_custkey, "left_semi")
        .join(near, customer.c_nationkey == near.n_nationkey, "left_semi").select("c_custkey", "c_name")
    )


@query(
    "join_anti",
    """SELECT c_custkey, c_name FROM customer
       WHERE NULLIF(c_custkey, 7) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)
         AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3)""",
)
def join_anti(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    buyers = table(spark, folder, "orders").where(F.col("o_totalprice") > 480000)
    near = nation.where(F.col("n_regionkey") < 3)
    nullable = customer.withColumn("key", F.nullif("c_custkey", F.lit(7)))
    return not_in(nullable, "key", buyers, "o_custkey").join(
        near, nullable.c_nationkey == near.n_nationkey, "left_anti").select("c_custkey", "c_name")


@query(
    "join_not_in_null",
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders WHERE o_custkey < 5)
       UNION ALL SELECT c_custkey FROM customer WHERE NULLIF(c_custkey, 7) NOT IN (SELECT o_custkey FROM orders WHERE o_custkey < 0)""",
)
def join_not_in_null(spark, folder):
    """A list with NULL lets nothing through, an empty list everything, NULL too."""
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    listed = orders.where("o_custkey < 5").select(F.nullif("o_custkey", F.lit(1)).alias("key"))
    nullable = customer.withColumn("key", F.nullif("c_custkey", F.lit(7)))
    return not_in(customer, "c_custkey", listed, "key").select("c_custkey").unionAll(
        not_in(nullable, "key", orders.where("o_custkey < 0"), "o_custkey").select("c_custkey"))


def _keys(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("key"))
    buyers = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"))
    return parts, buyers


_PART_KEYS = "SELECT p_partkey AS key FROM part"
_BUYER_KEYS = "SELECT o_custkey AS key FROM orders"


@query("set_union", f"{_PART_KEYS} UNION {_BUYER_KEYS}")
def set_union(spark, folder):
    parts, buyers = _keys(spark, folder)
    return parts.union(buyers).distinct()


@query("set_union_all", f"{_PART_KEYS} UNION ALL {_BUYER_KEYS}")
def set_union_all(spark, folder):
    parts, buyers = _keys(spark, folder)
    return parts.union(buyers)


@query("set_except", f"{_PART_KEYS} EXCEPT {_BUYER_KEYS}")
def set_except(spark, folder):
    parts, buyers = _keys(spark, folder)
    return parts.distinct().subtract(buyers.distinct())


@query("set_intersect", f"{_PART_KEYS} INTERSECT {_BUYER_KEYS}")
def set_intersect(spark, folder):
    parts, buyers = _keys(spark, folder)
    return parts.distinct().intersect(buyers.distinct())


@query(
    "sql_case",
    """SELECT CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS amount,
              CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' END AS flag, COUNT(*) AS n
       FROM lineitem GROUP BY 1, 2""",
)
def sql_case(spark, folder):
    amount = F.when(F.col("l_quantity") < 10, "few").when(F.col("l_quantity") < 30, "some").otherwise("many")
    flag = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted")
    return table(spark, folder, "lineitem").groupBy(amount.alias("amount"), flag.alias("flag")).agg(
        F.count(F.lit(1)).alias("n")
    )


MONTHLY = """
    WITH priced AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, o_totalprice FROM {orders}),
         monthly AS (SELECT m, COUNT(*) AS n, SUM(o_totalprice) AS total FROM priced GROUP BY m)
    SELECT CAST(m AS BIGINT) AS m, n, ROUND(total / n, 4) AS mean FROM monthly WHERE n > 10
"""


@query("sql_cte", MONTHLY.format(orders="orders"))
def sql_cte(spark, folder):
    return spark.sql(MONTHLY, orders=table(spark, folder, "orders"))


# one step per quarter between the first and the last shipment
CALENDAR = """
    WITH RECURSIVE shipped AS (
        SELECT CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS BIGINT) AS q, COUNT(*) AS n,
               SUM(l_quantity) AS quantity FROM {lineitem} GROUP BY 1),
    calendar(q, last_q) AS (
        SELECT MIN(q), MAX(q) FROM shipped
        UNION ALL SELECT q + 1, last_q FROM calendar WHERE q < last_q)
    SELECT c.q, COALESCE(s.n, 0) AS n, COALESCE(s.quantity, 0.0e0) AS quantity
    FROM calendar AS c LEFT JOIN shipped AS s ON c.q = s.q
"""


@query("sql_recursive", CALENDAR.format(lineitem="lineitem"))
def sql_recursive(spark, folder):
    unbound_recursion(spark)
    return spark.sql(CALENDAR, lineitem=table(spark, folder, "lineitem"))


DAYS = """
    WITH RECURSIVE span AS (SELECT MIN(o_orderdate) AS first_day, MIN(o_orderdate) + INTERVAL 300 DAY AS last_day FROM {orders}),
    days(d, last_day) AS (
        SELECT first_day, last_day FROM span
        UNION ALL SELECT d + INTERVAL 1 DAY, last_day FROM days WHERE d < last_day),
    sold AS (SELECT o_orderdate AS d, COUNT(*) AS n FROM {orders} GROUP BY 1)
    SELECT CAST(CAST(days.d AS DATE) AS STRING) AS d, COALESCE(sold.n, 0) AS n FROM days LEFT JOIN sold ON days.d = sold.d
"""


@query("sql_recursive_days", DAYS.format(orders="orders"))
def sql_recursive_days(spark, folder):
    # three hundred steps, one a day
    unbound_recursion(spark)
    return spark.sql(DAYS, orders=table(spark, folder, "orders"))


@query(
    "win_rank",
    """SELECT o_orderkey, o_orderstatus,
              ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS row_number,
              RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS rank,
              DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS dense_rank
       FROM orders""",
)
def win_rank(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    window = SplitWindow(["o_orderstatus"], ["o_orderdate"], ["o_orderkey"])
    return window.row_number("row_number").rank("rank").dense_rank("dense_rank").apply(orders).drop("o_orderdate")


@query(
    "win_rank_desc",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN month(o_orderdate) END AS m FROM orders)
       SELECT o_orderkey, o_orderstatus,
              RANK() OVER (PARTITION BY o_orderstatus ORDER BY m DESC NULLS LAST) AS rank_last,
              DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY m DESC NULLS LAST) AS dense_last,
              ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY m DESC NULLS LAST, o_orderkey DESC) AS row_last,
              RANK() OVER (PARTITION BY o_orderstatus ORDER BY m NULLS FIRST) AS rank_first
       FROM o""",
)
def win_rank_desc(spark, folder):
    # twelve order values and NULL in a group: its peers lie over many partitions
    month = F.when(F.col("o_orderkey") % 5 != 0, F.month("o_orderdate"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", month.alias("m"))
    last = SplitWindow(["o_orderstatus"], [Order("m", descending=True)], [Order("o_orderkey", descending=True)])
    ranked = last.rank("rank_last").dense_rank("dense_last").row_number("row_last").apply(orders)
    return SplitWindow(["o_orderstatus"], [Order("m", nulls_first=True)]).rank("rank_first").apply(ranked).drop("m")


@query(
    "win_frames",
    """SELECT o_orderkey,
              ROUND(SUM(o_totalprice) OVER (w ROWS 2 PRECEDING), 2) AS last_three,
              MAX(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS near_max,
              COUNT(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS following,
              LEAD(o_orderkey, 5) OVER w AS fifth_next
       FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey)""",
)
def win_frames(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    price = F.col("o_totalprice")
    window = SplitWindow(["o_orderstatus"], [Order("o_orderdate", descending=True)], ["o_orderkey"])
    framed = window.rows("last_three", F.sum, price, -2, 0).rows("near_max", F.max, price, -3, 4).rows(
        "following", F.count, F.lit(1), 1, 2).lead("fifth_next", F.col("o_orderkey"), 5).apply(orders)
    return framed.withColumn("last_three", F.round("last_three", 2)).drop("o_orderstatus", "o_orderdate", "o_totalprice")


@query(
    "win_group_totals",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(SUM(l_quantity) OVER (PARTITION BY l_returnflag), 2) AS group_quantity,
              COUNT(*) OVER (PARTITION BY l_returnflag) AS group_rows FROM lineitem""",
)
def win_group_totals(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    window = SplitWindow(["l_returnflag"], ["l_orderkey", "l_linenumber"]).total("group_quantity", F.col("l_quantity")).count("group_rows")
    return window.apply(lines).withColumn("group_quantity", F.round("group_quantity", 2)).drop("l_returnflag", "l_quantity")


@query(
    "win_lag_lead",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
              LAG(l_extendedprice) OVER w AS previous, LEAD(l_extendedprice) OVER w AS next
       FROM lineitem
       WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)""",
)
def win_lag_lead(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice"
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    price = F.col("l_extendedprice")
    window = SplitWindow(["l_returnflag"], order)
    return window.lag("previous", price).lead("next", price).apply(lines).drop("l_returnflag", "l_extendedprice")


@query(
    "win_running_sum",
    """SELECT event_id, event_type,
              ROUND(SUM(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2)
              AS running, COUNT(*) OVER (PARTITION BY event_type) AS n
       FROM events""",
)
def win_running_sum(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    window = SplitWindow(["event_type"], ["ts", "event_id"]).running_sum("running", F.col("value")).count("n")
    return window.apply(events).select("event_id", "event_type", F.round("running", 2).alias("running"), "n")
