"""Aggregate and scalar functions, under the names and meanings users expect."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import columns as fn
from tallygrid.functions.scalar_sql import register_functions
from tallygrid.plans.counted_quantiles import grouped_quantiles
from tallygrid.plans.order_statistics import DISCRETE, Quantile
from tallygrid.queries.profiles import GAPS_ORACLE, orders_with_gaps
from tallygrid.queries.registry import query, table
from tallygrid.types import text_to_double

# aggregates --------------------------------------------------------------------

@query(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS line_sum,
              ROUND(SUM(l_extendedprice), 2) AS price_sum, ROUND(AVG(l_quantity), 6) AS quantity_avg,
              MIN(l_shipdate) AS first_date, MAX(l_extendedprice) AS price_max
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def agg_basic(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("line_sum"),
        F.round(F.sum("l_extendedprice"), 2).alias("price_sum"), F.round(F.avg("l_quantity"), 6).alias("quantity_avg"),
        F.min("l_shipdate").alias("first_date"), F.max("l_extendedprice").alias("price_max"),
    )


@query(
    "agg_total",
    GAPS_ORACLE + """SELECT o_orderpriority, ROUND(COALESCE(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END),
        0.0e0), 2) AS total FROM t GROUP BY o_orderpriority""",
)
def agg_total(spark, folder):
    finished = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return orders_with_gaps(spark, folder).groupBy("o_orderpriority").agg(F.round(fn.total(finished), 2).alias("total"))


@query(
    "agg_group_concat",
    GAPS_ORACLE + """SELECT o_orderpriority, STRING_AGG(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses
       FROM t GROUP BY o_orderpriority""",
)
def agg_group_concat(spark, folder):
    return orders_with_gaps(spark, folder).groupBy("o_orderpriority").agg(
        fn.group_concat(F.col("o_orderstatus"), distinct=True).alias("statuses")
    )


@query(
    "agg_group_concat_all",
    GAPS_ORACLE + "SELECT o_custkey, STRING_AGG(o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM t GROUP BY o_custkey",
)
def agg_group_concat_all(spark, folder):
    return orders_with_gaps(spark, folder).groupBy("o_custkey").agg(fn.group_concat(F.col("o_orderstatus")).alias("statuses"))


@query(
    "agg_dispersion",
    """SELECT l_returnflag, ROUND(MEDIAN(l_extendedprice), 4) AS median, ROUND(STDDEV(l_extendedprice), 4) AS stddev,
              ROUND(VARIANCE(l_quantity), 4) AS variance FROM lineitem GROUP BY l_returnflag""",
)
def agg_dispersion(spark, folder):
    lines = table(spark, folder, "lineitem")
    spread = lines.groupBy("l_returnflag").agg(
        F.round(F.stddev("l_extendedprice"), 4).alias("stddev"), F.round(F.variance("l_quantity"), 4).alias("variance")
    )
    middle = grouped_quantiles(lines, ["l_returnflag"], "l_extendedprice", (Quantile("median", 0.5),))
    return spread.join(middle.withColumn("median", F.round("median", 4)), "l_returnflag")


@query(
    "agg_quantile",
    """SELECT l_returnflag, l_linestatus, QUANTILE_DISC(l_extendedprice, 0.9) AS quantile,
              ROUND(QUANTILE_CONT(l_extendedprice, 0.25), 4) AS quantile_cont,
              ROUND(QUANTILE_CONT(l_extendedprice, 0.95), 4) AS percentile
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def agg_quantile(spark, folder):
    found = grouped_quantiles(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
        (Quantile("quantile", 0.9, DISCRETE), Quantile("quantile_cont", 0.25), Quantile("percentile", 0.95)),
    )
    return found.withColumns({c: F.round(c, 4) for c in ("quantile_cont", "percentile")})


@query(
    "agg_quantile_builtin",
    """SELECT l_linenumber, QUANTILE_DISC(l_quantity, 0.3) AS quantile, ROUND(QUANTILE_CONT(l_quantity, 0.3), 4) AS
       quantile_cont FROM lineitem GROUP BY l_linenumber""",
)
def agg_quantile_builtin(spark, folder):
    # fifty different quantities: the built-in's state is bounded by them
    return table(spark, folder, "lineitem").groupBy("l_linenumber").agg(
        fn.quantile("l_quantity", 0.3).alias("quantile"),
        F.round(fn.quantile_cont(F.col("l_quantity"), 0.3), 4).alias("quantile_cont"),
    )


@query(
    "agg_first_last",
    """SELECT o_custkey, FIRST(o_totalprice ORDER BY o_orderdate, o_orderkey) AS first_price,
              LAST(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS last_priority FROM orders GROUP BY o_custkey""",
)
def agg_first_last(spark, folder):
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        fn.first_by(F.col("o_totalprice"), order).alias("first_price"),
        fn.last_by(F.col("o_orderpriority"), order).alias("last_priority"),
    )


@query(
    "agg_list",
    GAPS_ORACLE + """SELECT o_custkey, COUNT(*) AS n,
        ARRAY_TO_STRING(LIST(COALESCE(o_orderstatus, 'NULL') ORDER BY o_orderstatus NULLS LAST), ',') AS statuses
       FROM t GROUP BY o_custkey""",
)
def agg_list(spark, folder):
    listed = orders_with_gaps(spark, folder).groupBy("o_custkey").agg(fn.list_all(F.col("o_orderstatus")).alias("statuses"))
    return listed.select(
        "o_custkey", F.size("statuses").cast("bigint").alias("n"), F.array_join("statuses", ",", "NULL").alias("statuses"))


@query(
    "agg_count_distinct",
    """SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_count_distinct(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts")
    )


# scalars -----------------------------------------------------------------------

@query(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, ABS(l_quantity - 25) AS abs, ROUND(l_extendedprice / 3, 2) AS round,
              CAST(FLOOR(l_extendedprice) AS BIGINT) AS floor, CAST(CEIL(l_extendedprice) AS BIGINT) AS ceil,
              CAST(CEILING(l_tax) AS BIGINT) AS ceiling, ROUND(SQRT(l_extendedprice), 8) AS sqrt,
              POWER(l_quantity, 2) AS power, ROUND(EXP(l_discount), 10) AS exp, MOD(l_partkey, 7) AS mod,
              l_suppkey % 3 AS remainder, ROUND(l_linenumber / 4, 10) AS ratio,
              l_quantity / NULLIF(l_discount, 0) AS quotient, CAST(SIGN(l_quantity - 25) AS INTEGER) AS sign
       FROM lineitem""",
)
def fn_math(spark, folder):
    c = F.col
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs(c("l_quantity") - 25).alias("abs"),
        F.round(c("l_extendedprice") / 3, 2).alias("round"), F.floor("l_extendedprice").alias("floor"),
        F.ceil("l_extendedprice").alias("ceil"), F.ceiling("l_tax").alias("ceiling"),
        F.round(F.sqrt("l_extendedprice"), 8).alias("sqrt"), F.pow("l_quantity", F.lit(2)).alias("power"),
        F.round(F.exp("l_discount"), 10).alias("exp"), (c("l_partkey") % 7).alias("mod"),
        (c("l_suppkey") % 3).alias("remainder"), F.round(fn.divide(c("l_linenumber"), F.lit(4)), 10).alias("ratio"),
        fn.divide(c("l_quantity"), c("l_discount")).alias("quotient"),
        F.sign(c("l_quantity") - 25).cast("int").alias("sign"),
    )


@query(
    "fn_log",
    """SELECT p_partkey, ROUND(LOG(p_retailprice), 10) AS log, ROUND(LN(p_retailprice), 10) AS ln,
              ROUND(LN(NULLIF(p_size - 1, 0)), 10) AS ln_size FROM part""",
)
def fn_log(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.round(fn.log(F.col("p_retailprice")), 10).alias("log"),
        F.round(F.ln("p_retailprice"), 10).alias("ln"), F.round(F.ln(F.col("p_size") - 1), 10).alias("ln_size"),
    )


@query("fn_random", "SELECT COUNT(*) AS n, COUNT(*) AS in_range, TRUE AS varied FROM orders")
def fn_random(spark, folder):
    drawn = table(spark, folder, "orders").select(F.rand().alias("r"))
    return drawn.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"),
        (F.max("r") > F.min("r")).alias("varied"),
    )


@query(
    "fn_string",
    """SELECT c_custkey, LENGTH(c_name) AS length, LOWER(c_name) AS lower, UPPER(c_mktsegment) AS upper,
              TRIM('  ' || c_mktsegment || ' ') AS trim, LTRIM('  ' || c_mktsegment || ' ') AS ltrim,
              RTRIM('  ' || c_mktsegment || ' ') AS rtrim, SUBSTR(c_name, 10, 5) AS substr,
              SUBSTRING(c_name, 3) AS substring, REPLACE(c_name, '#', ' no. ') AS replace, LEFT(c_name, 4) AS "left",
              RIGHT(c_name, 3) AS "right", REPEAT(LEFT(c_mktsegment, 2), 3) AS repeat, REVERSE(c_name) AS reverse,
              INSTR(c_name, '#') AS instr
       FROM customer""",
)
def fn_string(spark, folder):
    segment, padded = F.col("c_mktsegment"), F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))
    return table(spark, folder, "customer").select(
        "c_custkey", F.length("c_name").cast("bigint").alias("length"), F.lower("c_name").alias("lower"),
        F.upper(segment).alias("upper"), F.trim(padded).alias("trim"), F.ltrim(padded).alias("ltrim"),
        F.rtrim(padded).alias("rtrim"), F.substr("c_name", F.lit(10), F.lit(5)).alias("substr"),
        F.substr("c_name", F.lit(3)).alias("substring"), F.replace("c_name", F.lit("#"), F.lit(" no. ")).alias("replace"),
        F.left("c_name", F.lit(4)).alias("left"), F.right("c_name", F.lit(3)).alias("right"),
        F.repeat(F.left(segment, F.lit(2)), 3).alias("repeat"), F.reverse("c_name").alias("reverse"),
        F.instr("c_name", "#").cast("bigint").alias("instr"),
    )


@query(
    "fn_string_unicode",
    """SELECT doc_id, LENGTH(text) AS length, UPPER(text) AS upper, REVERSE(text) AS reverse,
              INSTR(text, 'é') AS instr, LENGTH(REPLACE(text, ' ', '')) AS letters FROM documents""",
)
def fn_string_unicode(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("length"), fn.upper(F.col("text")).alias("upper"),
        F.reverse("text").alias("reverse"), F.instr("text", "é").cast("bigint").alias("instr"),
        F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("bigint").alias("letters"),
    )


@query(
    "fn_concat",
    GAPS_ORACLE + "SELECT o_orderkey, CONCAT(o_orderpriority, '/', o_orderstatus, '/', o_custkey) AS label FROM t",
)
def fn_concat(spark, folder):
    c = F.col
    return orders_with_gaps(spark, folder).select(
        "o_orderkey",
        fn.concat(c("o_orderpriority"), F.lit("/"), c("o_orderstatus"), F.lit("/"), c("o_custkey")).alias("label"),
    )


@query(
    "fn_convert",
    GAPS_ORACLE + """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS custkey_text, CAST(o_custkey AS DOUBLE) AS
        custkey_double, COALESCE(o_totalprice, -1) AS price, NULLIF(o_custkey, 5) AS custkey,
        IFNULL(o_orderstatus, 'none') AS status, TRY_CAST(SUBSTR(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
        TRY_CAST(o_orderstatus || '1' AS DOUBLE) AS no_number FROM t""",
)
def fn_convert(spark, folder):
    return orders_with_gaps(spark, folder).select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("custkey_text"),
        F.col("o_custkey").cast("double").alias("custkey_double"),
        F.coalesce("o_totalprice", F.lit(-1.0)).alias("price"), F.nullif("o_custkey", F.lit(5)).alias("custkey"),
        F.ifnull("o_orderstatus", F.lit("none")).alias("status"),
        text_to_double(F.substr("o_orderpriority", F.lit(1), F.lit(1))).alias("priority"),
        text_to_double(F.concat("o_orderstatus", F.lit("1"))).alias("no_number"),
    )


@query(
    "fn_typeof",
    """SELECT event_type, CASE TYPEOF(event_id) WHEN 'BIGINT' THEN 'bigint' END AS id_type,
              CASE TYPEOF(value) WHEN 'DOUBLE' THEN 'double' END AS value_type,
              CASE TYPEOF(props) WHEN 'VARCHAR' THEN 'string' END AS props_type, COUNT(*) AS n
       FROM events GROUP BY ALL""",
)
def fn_typeof(spark, folder):
    return table(spark, folder, "events").groupBy(
        "event_type", F.typeof("event_id").alias("id_type"), F.typeof("value").alias("value_type"),
        F.typeof("props").alias("props_type"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_date",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, STRFTIME(ts, '%H:%M:%S') AS time,
              CAST(STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS datetime FROM events""",
)
def fn_date(spark, folder):
    ts = F.col("ts")
    return table(spark, folder, "events").select(
        "event_id", F.to_date(ts).cast("string").alias("date"), fn.time_of(ts).alias("time"),
        fn.datetime_of(F.concat_ws(" ", F.to_date(ts).cast("string"), fn.time_of(ts))).alias("datetime"),
    )


_FORMATS = ("%Y-%m", "%d/%m/%Y %H:%M:%S", "day %j of %Y", "%y%m%d", "%I:%M %p", "%A %d %B", "%a %b", "%S.%f", "100%%")


@query(
    "fn_strftime",
    "SELECT event_id, " + ", ".join(f"STRFTIME(ts, '{f}') AS f{i}" for i, f in enumerate(_FORMATS)) + " FROM events",
)
def fn_strftime(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", *[fn.strftime(F.col("ts"), f).alias(f"f{i}") for i, f in enumerate(_FORMATS)]
    )


@query(
    "fn_strftime_sql",
    "SELECT o_orderkey, STRFTIME(o_orderdate, '%Y-%m') AS month, STRFTIME(o_orderdate, 'on %d.%m.%y') AS day FROM orders",
)
def fn_strftime_sql(spark, folder):
    register_functions(spark)
    return spark.sql(
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, 'on %d.%m.%y') AS day "
        "FROM {orders}",
        orders=table(spark, folder, "orders"),
    )


@query(
    "fn_date_parts",
    """SELECT event_id, YEAR(ts) AS year, MONTH(ts) AS month, DAY(ts) AS day, HOUR(ts) AS hour, MINUTE(ts) AS minute,
              SECOND(ts) AS second FROM events""",
)
def fn_date_parts(spark, folder):
    parts = {n: getattr(F, n)("ts").cast("bigint") for n in ("year", "month", "day", "hour", "minute", "second")}
    return table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "fn_iif",
    GAPS_ORACLE + """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size FROM t""",
)
def fn_iif(spark, folder):
    size = fn.iif(F.col("o_totalprice") > 200000, F.lit("large"), F.lit("small"))
    return orders_with_gaps(spark, folder).select("o_orderkey", size.alias("size"))


@query(
    "fn_misc",
    """SELECT s_suppkey, PRINTF('%05d-%s', s_suppkey, s_name) AS printf, HEX(s_name) AS hex, HEX(s_suppkey) AS hex_key,
              '''' || REPLACE(REPLACE(s_name, '#', ''''), '''', '''''') || '''' AS quote FROM supplier""",
)
def fn_misc(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey", F.printf(F.lit("%05d-%s"), F.col("s_suppkey"), F.col("s_name")).alias("printf"),
        F.hex("s_name").alias("hex"), F.hex("s_suppkey").alias("hex_key"),
        fn.quote(F.replace("s_name", F.lit("#"), F.lit("'"))).alias("quote"),
    )
