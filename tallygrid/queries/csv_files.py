"""CSV export and load. Every file read here was exported from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators.catalog import table_name_for
from tallygrid.queries.registry import query, table, union_all
from tallygrid.session import new_folder
from tallygrid.sources.csv_encoding import audit_encodings
from tallygrid.sources.csv_export import export_csv, export_encoded
from tallygrid.sources.csv_load import load_csv
from tallygrid.types import category
from tallygrid.workbench import Workbench


@query("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(spark, folder):
    path = export_csv(table(spark, folder, "orders"), new_folder(spark, "export"))
    return load_csv(spark, path).frame()


@query("csv_export_text", "SELECT * FROM conversations")
def csv_export_text(spark, folder):
    # texts with line breaks, commas and quotes
    path = export_csv(table(spark, folder, "conversations"), new_folder(spark, "export"))
    return load_csv(spark, path).frame()


@query(
    "csv_sniff",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, ';' AS sep "
    "FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, '|' FROM customer",
)
def csv_sniff(spark, folder):
    loaded = []
    for sep in ";|":
        path = export_csv(table(spark, folder, "customer"), new_folder(spark, "export"), sep=sep)
        found = load_csv(spark, path)
        loaded.append(found.frame().withColumn("sep", F.lit(found.plan.dialect.sep)))
    return loaded[0].unionByName(loaded[1])


_EVENT_CATEGORIES = {
    "event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float",
    "props": "string",
}


@query(
    "csv_infer",
    union_all([
        f"SELECT '{c}' AS column_name, '{k}' AS category, COUNT({c}) AS n, COUNT(DISTINCT {c}) AS unique_count "
        "FROM events" for c, k in _EVENT_CATEGORIES.items()
    ]),
)
def csv_infer(spark, folder):
    from tallygrid.operators.profile import profile_columns

    path = export_csv(table(spark, folder, "events"), new_folder(spark, "export"))
    loaded = load_csv(spark, path).frame()
    kinds = F.create_map(*[F.lit(v) for f in loaded.schema for v in (f.name, category(f.dataType))])
    return profile_columns(loaded).select(
        "column_name", kinds[F.col("column_name")].alias("category"),
        (F.col("total_count") - F.col("null_count")).alias("n"), "unique_count",
    )


@query(
    "csv_rejects",
    """SELECT CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' THEN 'number of fields' ELSE 'kept' END
         AS outcome, COUNT(*) AS n, CAST(SUM(CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'
         THEN 0 ELSE o_orderkey END) AS BIGINT) AS key_sum FROM orders GROUP BY 1""",
)
def csv_rejects(spark, folder):
    # lines with a field too many or too few, under a header of three columns
    line = F.when(
        F.col("o_orderstatus") == "P", F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ).when(
        F.col("o_orderpriority") == "1-URGENT", F.concat_ws(",", "o_orderkey", "o_custkey")
    ).otherwise(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus"))
    path = new_folder(spark, "export")
    table(spark, folder, "orders").select(line.alias("o_orderkey,o_custkey,o_orderstatus")).write.options(
        header=True, sep="\u0001", quote=""
    ).csv(path)
    loaded = load_csv(spark, path)
    kept = loaded.frame().agg(
        F.lit("kept").alias("outcome"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")
    )
    rejected = loaded.rejects().groupBy(F.col("reason").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("key_sum")
    )
    return kept.unionByName(rejected)


_ENCODINGS = {"fr": "ISO-8859-1", "de": "UTF-16", "es": "UTF-8", "en": "UTF-8"}
_ENCODING_SQL = "CASE lang " + " ".join(f"WHEN '{l}' THEN '{e}'" for l, e in _ENCODINGS.items()) + " END"


@query("csv_encoding", f"SELECT doc_id, lang, text, {_ENCODING_SQL} AS encoding FROM documents")
def csv_encoding(spark, folder):
    documents = table(spark, folder, "documents")
    out = []
    for lang, encoding in _ENCODINGS.items():
        path = export_encoded(
            documents.where(F.col("lang") == lang).select("doc_id", "lang", "text"),
            new_folder(spark, "export"), encoding,
        )
        loaded = load_csv(spark, path)
        out.append(loaded.frame().withColumn("encoding", F.lit(loaded.plan.encoding)))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("csv_encoding_audit", f"SELECT DISTINCT lang, {_ENCODING_SQL} AS encoding FROM documents")
def csv_encoding_audit(spark, folder):
    documents = table(spark, folder, "documents")
    root = new_folder(spark, "export")
    paths = [
        export_encoded(documents.where(F.col("lang") == lang).select("text"), f"{root}/{lang}", encoding)
        for lang, encoding in _ENCODINGS.items()
    ]
    found = audit_encodings(spark, paths)
    return found.select(F.regexp_extract("file", r"/(\w\w)/[^/]+$", 1).alias("lang"), "encoding").distinct()


@query(
    "csv_manifest",
    """SELECT 'orders_' || CAST(year(o_orderdate) AS VARCHAR) AS table_name, COUNT(*) AS row_count,
              ROUND(SUM(o_totalprice), 2) AS total, TRUE AS loaded FROM orders GROUP BY 1
       UNION ALL SELECT 'orders_none', 0, NULL, FALSE""",
)
def csv_manifest(spark, folder):
    orders = table(spark, folder, "orders")
    root = new_folder(spark, "export")
    years = [r[0] for r in orders.select(F.year("o_orderdate").alias("y")).distinct().orderBy("y").collect()]
    paths = [export_csv(orders.where(F.year("o_orderdate") == y), f"{root}/orders_{y}") for y in years]
    bench = Workbench(spark)
    statuses = bench.load_files([*paths, f"{root}/orders_none"])
    shown = [
        bench.table(s.table_name).agg(
            F.lit(table_name_for(s.path)).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
            F.round(F.sum("o_totalprice"), 2).alias("total"), F.lit(True).alias("loaded"),
        ) if s.error is None else spark.range(1).select(
            F.lit(table_name_for(s.path)).alias("table_name"), F.lit(0).cast("bigint").alias("row_count"),
            F.lit(None).cast("double").alias("total"), F.lit(False).alias("loaded"),
        )
        for s in statuses
    ]
    out = shown[0]
    for frame in shown[1:]:
        out = out.unionByName(frame)
    return out


@query(
    "table_info",
    """SELECT 'supplier' AS name, COUNT(*) AS row_count, 'UTF-8' AS encoding,
              's_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double' AS columns, TRUE AS has_size
       FROM supplier""",
)
def table_info(spark, folder):
    path = export_csv(table(spark, folder, "supplier"), new_folder(spark, "export"))
    bench = Workbench(spark)
    bench.load_csv(path, "supplier")
    info = bench.table_info("supplier")
    return bench.table("supplier").agg(
        F.lit(info.name).alias("name"), F.count(F.lit(1)).alias("row_count"), F.lit(info.encoding).alias("encoding"),
        F.lit(", ".join(f"{c['name']} {c['dtype']}" for c in info.columns)).alias("columns"),
        F.lit(info.file_size > 0).alias("has_size"),
    )


def _lines(frame, header: str, path: str) -> str:
    """Lines as they are, under a header."""
    frame.withColumnRenamed("line", header).write.options(header=True, sep="\u0001", quote="").csv(path)
    return path


@query(
    "csv_open_quotes",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN 'quote left open' ELSE 'kept' END AS outcome,
              CASE WHEN o_orderkey % 100 = 7 THEN NULL WHEN o_orderkey % 10 = 3 THEN 'first, of ' || o_orderkey || chr(10) || 'two'
                   ELSE o_orderpriority END AS note FROM orders""",
)
def csv_open_quotes(spark, folder):
    # one line in a hundred leaves a quote open, beside records that do go over two lines
    key = F.col("o_orderkey").cast("string")
    lines = F.when(F.col("o_orderkey") % 100 == 7, F.array(F.concat(key, F.lit(',"open')))).when(
        F.col("o_orderkey") % 10 == 3, F.array(F.concat(key, F.lit(',"first, of '), key), F.lit('two"'))
    ).otherwise(F.array(F.concat_ws(",", key, "o_orderpriority")))
    path = _lines(table(spark, folder, "orders").select(F.explode(lines).alias("line")), "o_orderkey,note", new_folder(spark, "export"))
    loaded = load_csv(spark, path)
    kept = loaded.frame().select("o_orderkey", F.lit("kept").alias("outcome"), "note")
    return kept.unionByName(loaded.rejects().select(
        F.split("line", ",")[0].cast("bigint").alias("o_orderkey"), F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("note")))


@query(
    "csv_late_quotes",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus || ', ' || o_orderkey ELSE o_orderstatus END AS note, '''' AS quote FROM orders",
)
def csv_late_quotes(spark, folder):
    # fields quoted by ' come last in each file
    key, late = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4 == 0
    line = F.when(late, F.concat(key, F.lit(",'"), "o_orderstatus", F.lit(", "), key, F.lit("'"))).otherwise(F.concat_ws(",", key, "o_orderstatus"))
    rows = table(spark, folder, "orders").select(line.alias("line"), late.alias("late")).sortWithinPartitions("late").select("line")
    loaded = load_csv(spark, _lines(rows, "o_orderkey,note", new_folder(spark, "export")))
    return loaded.frame().withColumn("quote", F.lit(loaded.plan.dialect.quote))
