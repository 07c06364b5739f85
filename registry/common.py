"""Frames the queries start from, with the same definition in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import shared_path as scratch  # noqa: F401

TABLE_COLUMNS = {
    "customer": {
        "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "part": {
        "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
        "p_size": "int", "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
        "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
        "value": "double", "props": "string",
    },
    "documents": {
        "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
    },
}
NUMERIC = ("bigint", "int", "double")


def numeric_of(table: str) -> list[str]:
    return [c for c, t in TABLE_COLUMNS[table].items() if t in NUMERIC]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def li_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with nulls in a number and in a text column."""
    df = read(spark, sf, "lineitem")
    return df.withColumns(
        {
            "l_discount": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")),
            "l_returnflag": F.nullif("l_returnflag", F.lit("R")),
        }
    )


LI_NULLS = """(SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount,
    nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)"""


def orders_copies(spark: SparkSession, sf: str) -> DataFrame:
    """orders with every fifth order twice and a nulled text column."""
    df = read(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return df.unionByName(df.where(F.col("o_orderkey") % 5 == 0))


ORDERS_COPIES = """(WITH o AS (SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)
    SELECT * FROM o UNION ALL SELECT * FROM o WHERE o_orderkey % 5 = 0)"""


def blank_conversations(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "conversations")
    return df.withColumn("text", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")))


BLANK_CONVERSATIONS = """(SELECT * REPLACE (CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END AS text) FROM conversations)"""


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def show_double(v: str) -> str:
    return (
        f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({v} AS VARCHAR) END"
    )


def shown(v: str, kind: str) -> str:
    return show_double(v) if kind == "double" else f"CAST({v} AS VARCHAR)"


def text_key(v: str, kind: str) -> str:
    """Key of long texts: a digest, so ties go by digest and not by the text."""
    return f"CASE WHEN length({v}) > 256 THEN substr({v}, 1, 256) || sha256({v}) ELSE {v} END" if kind == "string" else v
