"""Profiles: columns, tables, query results, missing values, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators import adhoc_profile, distribution, profile
from tallygrid.queries.registry import query, table, union_all

# orders with some values blanked; the test tables themselves hold no NULL
GAPS = """
    SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS o_totalprice,
           CASE WHEN o_totalprice < 300000 THEN NULL ELSE o_orderdate END AS o_orderdate,
           NULLIF(o_orderpriority, '1-URGENT') AS o_orderpriority
    FROM {orders}
"""
GAPS_ORACLE = f"WITH t AS ({GAPS.format(orders='orders')})\n"
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def orders_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(GAPS, orders=table(spark, folder, "orders"))


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0e0 ELSE ROUND({part} * 100.0e0 / {whole}, 2) END"


def _base(c: str, source: str = "t") -> str:
    nulls, distinct = f"(COUNT(*) - COUNT({c}))", f"COUNT(DISTINCT {c})"
    return (
        f"SELECT '{c}' AS column_name, COUNT(*) AS total_count, {nulls} AS null_count, "
        f"{_share(nulls, 'COUNT(*)')} AS null_percentage, {distinct} AS unique_count, "
        f"{_share(distinct, 'COUNT(*)')} AS unique_percentage FROM {source}"
    )


def _numeric(c: str) -> str:
    return (
        f"ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min_value, ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max_value, "
        f"ROUND(AVG({c}), 4) AS mean_value, ROUND(CAST(MEDIAN({c}) AS DOUBLE), 4) AS median_value, "
        f"ROUND(STDDEV({c}), 4) AS std_value, ROUND(QUANTILE_CONT({c}, 0.25), 4) AS q1_value, "
        f"ROUND(QUANTILE_CONT({c}, 0.75), 4) AS q3_value"
    )


_NO_NUMERIC = ", ".join(
    f"CAST(NULL AS DOUBLE) AS {c}"
    for c in ("min_value", "max_value", "mean_value", "median_value", "std_value", "q1_value", "q3_value")
)


def _lengths(c: str) -> str:
    return (
        f"MIN(LENGTH({c})) AS min_length, MAX(LENGTH({c})) AS max_length, "
        f"NULLIF(ROUND(AVG(LENGTH({c})), 2), 0) AS avg_length"
    )


_NO_LENGTHS = (
    "CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length, CAST(NULL AS DOUBLE) AS avg_length"
)


def _ranked(c: str, source: str, limit: int, keep_null: bool = False) -> str:
    where = "" if keep_null else f" WHERE {c} IS NOT NULL"
    value = f"CAST({c} AS VARCHAR)"
    if keep_null:
        value = f"COALESCE({value}, 'NULL')"
    return (
        f"(SELECT '{c}' AS column_name, "
        f"ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c} ASC NULLS LAST) AS rank, {value} AS value, COUNT(*) AS n "
        f"FROM {source}{where} GROUP BY {c} ORDER BY COUNT(*) DESC, {c} ASC NULLS LAST LIMIT {limit})"
    )


@query("profile_base", GAPS_ORACLE + union_all([_base(c) for c in ORDER_COLUMNS]))
def profile_base(spark, folder):
    return profile.profile_base(orders_with_gaps(spark, folder))


LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


@query(
    "profile_numeric",
    union_all([f"SELECT '{c}' AS column_name, {_numeric(c)} FROM lineitem" for c in LINEITEM_NUMBERS]),
)
def profile_numeric(spark, folder):
    return profile.profile_numeric(table(spark, folder, "lineitem"))


@query(
    "profile_string",
    union_all([f"SELECT '{c}' AS column_name, {_lengths(c)} FROM customer" for c in ("c_name", "c_mktsegment")]
              + ["SELECT 'blank' AS column_name, " + _lengths("blank")
                 + " FROM (SELECT REPLACE(c_name, c_name, '') AS blank FROM customer)"]),
)
def profile_string(spark, folder):
    customer = table(spark, folder, "customer")
    return profile.profile_string(customer.withColumn("blank", F.replace("c_name", F.col("c_name"), F.lit(""))))


@query(
    "profile_string_documents",
    union_all([f"SELECT '{c}' AS column_name, {_lengths(c)} FROM documents" for c in ("text", "lang", "source")]),
)
def profile_string_documents(spark, folder):
    return profile.profile_string(table(spark, folder, "documents"))


@query("profile_top10", GAPS_ORACLE + union_all([_ranked(c, "t", 10) for c in ORDER_COLUMNS]))
def profile_top10(spark, folder):
    return profile.profile_top_values(orders_with_gaps(spark, folder))


def _top_text(c: str, source: str) -> str:
    return (
        f"(SELECT STRING_AGG(value || '=' || CAST(n AS VARCHAR), '; ' ORDER BY rank) FROM {_ranked(c, source, 10)})"
    )


ORDER_CATEGORIES = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
    "o_orderdate": "datetime", "o_orderpriority": "string",
}


def _whole(c: str, position: int, category: str, source: str, width: int) -> str:
    numeric = _numeric(c) if category in ("integer", "float") else _NO_NUMERIC
    lengths = _lengths(c) if category == "string" else _NO_LENGTHS
    return (
        f"SELECT b.*, s.* FROM ({_base(c, source)}) AS b, "
        f"(SELECT 'orders' AS table_name, COUNT(*) AS row_count, CAST({width} AS BIGINT) AS column_count, "
        f"COUNT(*) * 100 AS memory_usage, CAST({position} AS BIGINT) AS position, '{category}' AS category, "
        f"{numeric}, {lengths}, {_top_text(c, source)} AS top_values FROM {source}) AS s"
    )


def _shown_top(frame: DataFrame) -> DataFrame:
    """Top values as one text; an array of structs has no common form."""
    text = F.transform("top_values", lambda e: F.concat_ws("=", e["value"], e["count"].cast("string")))
    return frame.drop("dtype").withColumn("top_values", F.array_join(text, "; "))


@query(
    "profile_table",
    GAPS_ORACLE + union_all([
        _whole(c, i, k, "t", len(ORDER_CATEGORIES)) for i, (c, k) in enumerate(ORDER_CATEGORIES.items())
    ]),
)
def profile_table(spark, folder):
    return _shown_top(profile.profile_table(orders_with_gaps(spark, folder), "orders"))


@query(
    "profile_column",
    f"""SELECT 'p_retailprice' AS column_name, TRUE AS is_numeric, b.total_count AS total_rows, b.unique_count,
        b.null_count AS missing_count, b.null_percentage AS missing_percentage, s.*
        FROM ({_base('p_retailprice', 'part')}) AS b,
        (SELECT {_numeric('p_retailprice')}, {_NO_LENGTHS}, {_top_text('p_retailprice', 'part')} AS top_values
         FROM part) AS s""",
)
def profile_column(spark, folder):
    return _shown_top(profile.profile_column(table(spark, folder, "part"), "p_retailprice"))


@query(
    "profile_column_text",
    f"""SELECT 'text' AS column_name, FALSE AS is_numeric, b.total_count AS total_rows, b.unique_count,
        b.null_count AS missing_count, b.null_percentage AS missing_percentage, s.*
        FROM ({_base('text', 'conversations')}) AS b,
        (SELECT {_NO_NUMERIC}, {_lengths('text')}, {_top_text('text', 'conversations')} AS top_values
         FROM conversations) AS s""",
)
def profile_column_text(spark, folder):
    return _shown_top(profile.profile_column(table(spark, folder, "conversations"), "text"))


@query(
    "dtype_summary",
    GAPS_ORACLE + """SELECT category, COUNT(*) AS column_count, CAST(SUM(null_count) AS BIGINT) AS null_count FROM (
         SELECT CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN column_type = 'DOUBLE' THEN 'float'
                     WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type LIKE 'TIMESTAMP%' THEN 'datetime'
                     ELSE 'other' END AS category, null_count
         FROM (DESCRIBE orders) JOIN (""" + union_all([
             f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM t" for c in ORDER_COLUMNS
         ]) + """) USING (column_name)) GROUP BY category""",
)
def dtype_summary(spark, folder):
    return profile.dtype_summary(orders_with_gaps(spark, folder))


@query(
    "null_summary",
    GAPS_ORACLE + union_all([
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM t" for c in ORDER_COLUMNS
    ]),
)
def null_summary(spark, folder):
    return profile.null_summary(orders_with_gaps(spark, folder))


def _missing(c: str) -> str:
    nulls = f"(COUNT(*) - COUNT({c}))"
    return (
        f"SELECT '{c}' AS column_name, {nulls} AS null_count, {_share(nulls, 'COUNT(*)')} AS null_percentage, "
        f"{nulls} > 0 AS has_missing FROM t"
    )


@query("missing_report", GAPS_ORACLE + union_all([_missing(c) for c in ORDER_COLUMNS]))
def missing_report(spark, folder):
    return profile.missing_report(orders_with_gaps(spark, folder))


_CELLS = " + ".join(f"(COUNT(*) - COUNT({c}))" for c in ORDER_COLUMNS)


@query(
    "missing_summary",
    GAPS_ORACLE + f"""SELECT COUNT(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns, COUNT(*) * 6 AS total_cells,
        {_CELLS} AS total_missing, {_share(f'({_CELLS})', '(COUNT(*) * 6)')} AS missing_percentage FROM t""",
)
def missing_summary(spark, folder):
    return profile.missing_summary(orders_with_gaps(spark, folder))


@query(
    "missing_ranked",
    GAPS_ORACLE + f"""SELECT column_name, null_count, null_percentage,
        CASE WHEN null_percentage > 50 THEN 'error' WHEN null_percentage > 20 THEN 'warning' ELSE 'success' END
        AS severity FROM ({union_all([_missing(c) for c in ORDER_COLUMNS])}) WHERE has_missing""",
)
def missing_ranked(spark, folder):
    return profile.missing_ranked(orders_with_gaps(spark, folder))


@query(
    "numeric_summary",
    GAPS_ORACLE + union_all([
        f"SELECT '{c}' AS column_name, {_numeric(c)}, COUNT(*) - COUNT({c}) AS null_count, "
        f"{_share(f'(COUNT(*) - COUNT({c}))', 'COUNT(*)')} AS null_percentage FROM t"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    ]),
)
def numeric_summary(spark, folder):
    return profile.numeric_summary(orders_with_gaps(spark, folder)).drop("dtype")


REVENUE = """
    SELECT o_orderpriority, l_extendedprice * (1 - l_discount) AS revenue,
           CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS {text}) END AS quantity_text
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'P'
"""


def _adhoc(c: str, dtype: str, numeric: bool) -> str:
    base = f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, COUNT(*) AS total_rows, " \
           f"COUNT(DISTINCT {c}) AS unique_count, COUNT(*) - COUNT({c}) AS missing_count, " \
           f"{_share(f'(COUNT(*) - COUNT({c}))', 'COUNT(*)')} AS missing_percentage, {numeric} AS is_numeric, "
    return base + (_numeric(f"CAST({c} AS DOUBLE)") if numeric else _NO_NUMERIC) + " FROM q"


@query(
    "profile_sql",
    f"WITH q AS ({REVENUE.format(lineitem='lineitem', orders='orders', text='VARCHAR')})\n" + union_all([
        _adhoc("revenue", "numeric", True), _adhoc("quantity_text", "numeric", True),
        _adhoc("o_orderpriority", "text", False),
    ]),
)
def profile_sql(spark, folder):
    result = spark.sql(
        REVENUE.replace("{text}", "STRING"),
        lineitem=table(spark, folder, "lineitem"), orders=table(spark, folder, "orders"),
    )
    return adhoc_profile.profile_sql_columns(result, ["revenue", "quantity_text", "o_orderpriority"])


# numbers as text, some of them missing in three ways or replaced by words
DIRTY = """
    SELECT CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN 'NULL'
                WHEN event_type = 'signup' AND value < 20 THEN 'n/a'
                WHEN event_type = 'signup' AND value > 100 THEN NULL
                ELSE CAST(value AS {text}) END AS v
    FROM {events}
"""
_DIRTY_ORACLE = f"""
    WITH d AS ({DIRTY.format(events='events', text='VARCHAR')}),
    p AS (SELECT NULLIF(NULLIF(v, ''), 'NULL') AS t FROM d),
    x AS (SELECT t, TRY_CAST(t AS DOUBLE) AS x FROM p),
    s AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) - 1 AS i, COUNT(*) OVER () AS n FROM x WHERE x IS NOT NULL)
"""


@query(
    "profile_lenient",
    _DIRTY_ORACLE + """
    SELECT 'v' AS column_name, 'numeric' AS dtype, COUNT(*) AS total_rows, COUNT(DISTINCT t) AS unique_count,
           COUNT(*) - COUNT(t) AS missing_count, (COUNT(*) - COUNT(t)) * 100.0e0 / COUNT(*) AS missing_percentage,
           COUNT(x) > COUNT(t) * 0.5e0 AS is_numeric, MIN(x) AS min_value, MAX(x) AS max_value,
           ROUND(AVG(x), 6) AS mean_value, ROUND(MEDIAN(x), 6) AS median_value, ROUND(STDDEV(x), 6) AS std_value,
           (SELECT x FROM s WHERE i = n // 4) AS q1_value, (SELECT x FROM s WHERE i = 3 * n // 4) AS q3_value
    FROM x""",
)
def profile_lenient(spark, folder):
    dirty = spark.sql(DIRTY.replace("{text}", "STRING"), events=table(spark, folder, "events"))
    rounded = {c: F.round(c, 6) for c in ("mean_value", "median_value", "std_value")}
    return adhoc_profile.profile_lenient(dirty, "v").withColumns(rounded)


@query(
    "profile_lenient_top",
    _DIRTY_ORACLE + """
    SELECT t AS value, COUNT(*) AS n FROM p WHERE t IS NOT NULL GROUP BY t ORDER BY n DESC, t LIMIT 10""",
)
def profile_lenient_top(spark, folder):
    dirty = spark.sql(DIRTY.replace("{text}", "STRING"), events=table(spark, folder, "events"))
    return adhoc_profile.lenient_top_values(dirty, "v")


@query(
    "histogram",
    """WITH s AS (SELECT MIN(l_extendedprice) AS low, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 20.0e0 AS width
                  FROM lineitem)
       SELECT CAST(FLOOR((l_extendedprice - low) / width) AS BIGINT) AS bin,
              ROUND(low + FLOOR((l_extendedprice - low) / width) * width, 6) AS bin_start, COUNT(*) AS n
       FROM lineitem, s GROUP BY 1, 2""",
)
def histogram(spark, folder):
    found = distribution.histogram(table(spark, folder, "lineitem"), "l_extendedprice")
    return found.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "frequency50",
    GAPS_ORACLE + """SELECT COALESCE(CAST(o_orderdate AS VARCHAR), 'NULL') AS value, COUNT(*) AS n FROM t
       GROUP BY o_orderdate ORDER BY n DESC, o_orderdate ASC NULLS LAST LIMIT 50""",
)
def frequency50(spark, folder):
    return distribution.frequency(orders_with_gaps(spark, folder), "o_orderdate")


@query(
    "distribution",
    """WITH s AS (SELECT MIN(n_chars) AS low, (MAX(n_chars) - MIN(n_chars)) / 50.0e0 AS width FROM documents)
       SELECT CAST(FLOOR((n_chars - low) / width) AS BIGINT) AS bin,
              ROUND(low + FLOOR((n_chars - low) / width) * width, 6) AS bin_start, COUNT(*) AS n
       FROM documents, s GROUP BY 1, 2""",
)
def distribution_of_lengths(spark, folder):
    found = distribution.distribution(table(spark, folder, "documents"), "n_chars", bins=50)
    return found.withColumn("bin_start", F.round("bin_start", 6))
