"""Loading, scanning and describing tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.common import TABLE_COLUMNS, fresh_name, read, scratch, union_all
from tablescope.operators import tables
from tablescope.schema import RESULT_TABLES
from tablescope.operators.tables import basic_profile
from tablescope.sources import csv, export, workspace
from tablescope.sources.results import append_results



_LI = TABLE_COLUMNS["lineitem"]


def _text_schema():
    return T.StructType.fromDDL(", ".join(f"{c} {'bigint' if t == 'int' else t.replace('_ntz', '_NTZ')}" for c, t in _LI.items()))


def _spoiled_csv(spark, sf):
    """All of lineitem in a CSV file: part keys of every 11th order and ship dates of every 13th spoiled,
    supplier keys with a fraction, empty cells, and a line break inside a quoted cell of every 17th order."""
    key = F.col("l_orderkey")
    cells = {c: F.col(c).cast("string") for c in _LI}
    cells["l_partkey"] = F.when(key % 11 == 0, "bad").otherwise(cells["l_partkey"])
    cells["l_suppkey"] = F.concat(cells["l_suppkey"], F.lit(".6"))
    cells["l_shipdate"] = F.when(key % 13 == 0, "soon").otherwise(cells["l_shipdate"])
    cells["l_tax"] = F.when(key % 5 != 0, cells["l_tax"])
    cells["l_returnflag"] = F.when(key % 17 == 0, F.concat(F.lit('x "'), F.col("l_returnflag"), F.lit('"\n,y'))).otherwise(F.nullif("l_returnflag", F.lit("R")))
    path = scratch(spark, "lineitem-csv")
    read(spark, sf, "lineitem").select(*[v.alias(c) for c, v in cells.items()]).write.option("header", True).option("escape", '"').csv(path)
    return path


_TEXT_SQL = """(SELECT * REPLACE (CAST(l_orderkey AS VARCHAR) AS l_orderkey,
    CASE WHEN l_orderkey % 11 = 0 THEN 'bad' ELSE CAST(l_partkey AS VARCHAR) END AS l_partkey,
    CAST(l_suppkey AS VARCHAR) || '.6' AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
    CAST(l_quantity AS VARCHAR) AS l_quantity, CAST(l_extendedprice AS VARCHAR) AS l_extendedprice, CAST(l_discount AS VARCHAR) AS l_discount,
    CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_tax AS VARCHAR) END AS l_tax,
    CASE WHEN l_orderkey % 17 = 0 THEN 'x "' || l_returnflag || '"' || chr(10) || ',y' ELSE nullif(l_returnflag, 'R') END AS l_returnflag,
    CASE WHEN l_orderkey % 13 = 0 THEN 'soon' ELSE CAST(l_shipdate AS VARCHAR) END AS l_shipdate) FROM lineitem)"""


def csv_ingest(spark, sf):
    path = scratch(spark, "customer-csv")
    read(spark, sf, "customer").write.option("header", True).csv(path)
    table = fresh_name("ingested")
    csv.csv_ingest(spark, path, table)
    return spark.table(table)


def csv_ingest_documents(spark, sf):
    """Prose with quotes, commas and line breaks, written to a CSV and loaded again."""
    path = scratch(spark, "documents-csv")
    docs = read(spark, sf, "documents")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    table = fresh_name("ingested")
    csv.csv_ingest(spark, path, table)
    return spark.table(table)


def csv_ingest_report(spark, sf):
    """A file with spoiled cells, loaded with the types it should have."""
    report = csv.csv_ingest(spark, _spoiled_csv(spark, sf), fresh_name("ingested"), _text_schema())
    cells = report["rejected_cells"]
    row = (report["rows_read"], report["rows_loaded"], report["rows_rejected"], report["unclosed_quotes"], cells["l_partkey"], cells["l_shipdate"], sum(cells.values()))
    return spark.createDataFrame(
        [row],
        "rows_read bigint, rows_loaded bigint, rows_rejected bigint, unclosed_quotes int, rejected_l_partkey bigint, rejected_l_shipdate bigint, rejected_cells bigint",
    )


def _spoiled_texts(spark, sf):
    return csv.read_text_columns(spark, _spoiled_csv(spark, sf), multiline=True)


def replace_table(spark, sf):
    table = fresh_name("replaced")
    csv.replace_table(read(spark, sf, "customer"), table)
    csv.replace_table(read(spark, sf, "orders"), table)
    return spark.table(table)


def workflow_sql(spark, sf):
    """Free SQL inside a workflow whose data table points at the given file."""
    workflow = workspace.create_workflow(spark)
    namespace = workspace.workflow_namespace(workflow)
    spark.sql(f"CREATE TABLE {namespace}.orders USING parquet LOCATION '{sf}/orders.parquet'")
    return workspace.workflow_sql(
        spark,
        namespace,
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
    )


def export_results(spark, sf):
    path = scratch(spark, "export")
    stats = basic_profile(read(spark, sf, "orders"))
    export.export_results(stats, stats, path, "csv")
    return spark.read.option("header", True).schema(stats.schema).csv(path)


def save_and_read_summary(spark, sf):
    """Append the summaries of two tables to the result store and read them back."""
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    for name in ("orders", "customer"):
        summary = tables.table_summary(read(spark, sf, name), name)
        append_results(summary, namespace, "workflow_eda_summary")
    stored = spark.table(f"{namespace}.workflow_eda_summary")
    return stored.select("table_name", "total_rows", "total_columns", "duplicate_rows", "analysis_type")


def _with_customers(spark, sf):
    """A workflow whose data table is customer."""
    workflow = workspace.create_workflow(spark)
    namespace = workspace.workflow_namespace(workflow)
    read(spark, sf, "customer").write.saveAsTable(f"{namespace}.customers")
    return workflow, namespace


def workflow_life(spark, sf):
    """What each step of a workflow's life finds, beside the rows of its data table."""
    workflow, namespace = _with_customers(spark, sf)
    found = workspace.find_data_table(spark, namespace)
    rows = [
        ("listed", workflow in workspace.list_workflows(spark), workspace.fetch(spark, namespace, found).count()),
        ("data table found", found == "customers", workspace.table_scan(spark, namespace, found).count()),
        ("data table exists", workspace.table_exists(spark, namespace, found)[0], spark.table(f"{namespace}.{found}").count()),
        ("other table exists", workspace.table_exists(spark, namespace, "orders")[0], 0),
        ("result tables empty", all(spark.table(f"{namespace}.{t}").isEmpty() for t in RESULT_TABLES), 0),
    ]
    workspace.delete_workflow(spark, workflow)
    rows.append(("listed after deletion", workflow in workspace.list_workflows(spark), 0))
    return spark.createDataFrame(rows, "step string, result boolean, data_rows bigint")


def export_json(spark, sf):
    """Summary and profile of orders as one nested JSON record, read back."""
    path = scratch(spark, "export")
    stats = basic_profile(read(spark, sf, "orders")).withColumn("analysis_id", F.lit("a"))
    summary = tables.table_summary(read(spark, sf, "orders"), "orders").withColumn("analysis_id", F.lit("a"))
    export.export_results(summary, stats, path, "json")
    kinds = {f.name: f.dataType for f in stats.schema}
    nested = spark.read.json(path).select(F.col("summary.table_name").alias("table_name"), F.inline("column_statistics"))
    return nested.select("table_name", *[F.col(c).cast(t).alias(c) for c, t in kinds.items() if c != "analysis_id"])


QUERIES = {
    "workflow_life": workflow_life,
    "fetch_df": lambda spark, sf: workspace.fetch(spark, _with_customers(spark, sf)[1], "customers"),
    "normalize_table_name": lambda spark, sf: read(spark, sf, "pages").select("page_id", csv.table_name_of(F.col("url")).alias("table_name")),
    "csv_ingest": csv_ingest,
    "csv_ingest_documents": csv_ingest_documents,
    "csv_ingest_report": csv_ingest_report,
    "csv_schema_infer": lambda spark, sf: csv.infer_types(_spoiled_texts(spark, sf)),
    "csv_tolerant_load": lambda spark, sf: csv.tolerant_cast(_spoiled_texts(spark, sf), _text_schema()),
    "load_report": lambda spark, sf: csv.load_report(_spoiled_texts(spark, sf), _text_schema()),
    "replace_table": replace_table,
    "preview": lambda spark, sf: tables.preview(read(spark, sf, "orders"), ["o_orderkey"]),
    "sample_rows": lambda spark, sf: tables.sample_rows(read(spark, sf, "orders"), 100, ["o_orderdate", "o_orderkey"]),
    "table_scan": lambda spark, sf: workspace.table_scan(spark, _with_customers(spark, sf)[1], "customers"),
    "describe_table": lambda spark, sf: tables.describe_table(read(spark, sf, "lineitem")).drop("family"),
    "row_count": lambda spark, sf: tables.row_count(read(spark, sf, "lineitem")),
    "workflow_sql": workflow_sql,
    "export_results": export_results,
    "export_json": export_json,
    "save_summary": save_and_read_summary,
}

_WHOLE = "CAST(round(TRY_CAST({c} AS DECIMAL(38,9))) AS BIGINT)"
_CELLS = {
    c: _WHOLE.format(c=c) if t in ("bigint", "int") else f"TRY_CAST({c} AS DOUBLE)" if t == "double"
    else f"TRY_CAST({c} AS TIMESTAMP)" if t == "timestamp_ntz" else c
    for c, t in _LI.items()
}
_BAD = {c: f"({c} IS NOT NULL AND {cell} IS NULL)" for c, cell in _CELLS.items()}


def _vote(i: int, c: str) -> str:
    whole = f"bool_and(regexp_matches({c}, '^[+-]?[0-9]+$') AND TRY_CAST({c} AS BIGINT) IS NOT NULL)"
    return f"""SELECT {i} AS ordinal, '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'double'
        WHEN count({c}) = count(*) AND {whole} THEN 'bigint'
        WHEN bool_and(TRY_CAST({c} AS DOUBLE) IS NOT NULL) FILTER (WHERE {c} IS NOT NULL) THEN 'double'
        ELSE 'string' END AS data_type FROM {_TEXT_SQL}"""


_BASIC_ORDERS = union_all(
    [
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS total_count,
        CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c})) * 100.0::DOUBLE / count(*) END AS null_percentage,
        count(DISTINCT {c}) AS unique_count, count(DISTINCT {c})::DOUBLE / count(*) AS cardinality_ratio FROM orders"""
        for c, t in {
            "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
            "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
        }.items()
    ]
)


def _summary(table: str, columns: int) -> str:
    return f"""SELECT '{table}' AS table_name, count(*) AS total_rows, {columns} AS total_columns,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicate_rows,
        'unsupervised' AS analysis_type FROM {table}"""


SQL = {
    "workflow_life": """SELECT 'listed' AS step, TRUE AS result, count(*) AS data_rows FROM customer
        UNION ALL SELECT 'data table found', TRUE, count(*) FROM customer UNION ALL SELECT 'data table exists', TRUE, count(*) FROM customer
        UNION ALL SELECT 'other table exists', FALSE, 0 UNION ALL SELECT 'result tables empty', TRUE, 0 UNION ALL SELECT 'listed after deletion', FALSE, 0""",
    "fetch_df": "SELECT * FROM customer",
    "normalize_table_name": r"""SELECT page_id, replace(replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '-', '_'), ' ', '_') AS table_name FROM pages""",
    "csv_ingest": "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer",
    "csv_ingest_documents": "SELECT * FROM documents",
    "csv_ingest_report": "SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT (" + " OR ".join(_BAD.values())
    + ")) AS rows_loaded, count(*) FILTER (WHERE " + " OR ".join(_BAD.values()) + ") AS rows_rejected, 0 AS unclosed_quotes, "
    + f"count(*) FILTER (WHERE {_BAD['l_partkey']}) AS rejected_l_partkey, count(*) FILTER (WHERE {_BAD['l_shipdate']}) AS rejected_l_shipdate, CAST("
    + " + ".join(f"count(*) FILTER (WHERE {b})" for b in _BAD.values()) + f" AS BIGINT) AS rejected_cells FROM {_TEXT_SQL}",
    "csv_schema_infer": union_all([_vote(i, c) for i, c in enumerate(_CELLS)]),
    "csv_tolerant_load": "SELECT " + ", ".join(f"{cell} AS {c}" for c, cell in _CELLS.items())
    + f" FROM {_TEXT_SQL} AS t WHERE NOT (" + " OR ".join(_BAD.values()) + ")",
    "load_report": "SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT (" + " OR ".join(_BAD.values())
    + ")) AS rows_loaded, count(*) FILTER (WHERE " + " OR ".join(_BAD.values()) + ") AS rows_rejected, "
    + ", ".join(f"count(*) FILTER (WHERE {b}) AS rejected_{c}" for c, b in _BAD.items()) + f" FROM {_TEXT_SQL}",
    "replace_table": "SELECT * FROM orders",
    "preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "sample_rows": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100",
    "table_scan": "SELECT * FROM customer",
    "describe_table": """SELECT CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name, CASE data_type
        WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
        WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS data_type
        FROM information_schema.columns WHERE table_name = 'lineitem'""",
    "row_count": "SELECT count(*) AS total_rows FROM lineitem",
    "workflow_sql": """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY o_orderstatus""",
    "export_results": _BASIC_ORDERS,
    "export_json": f"SELECT 'orders' AS table_name, * FROM ({_BASIC_ORDERS})",
    "save_summary": union_all([_summary("orders", 6), _summary("customer", 5)]),
}
