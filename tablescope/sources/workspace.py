"""Workflows: one catalog namespace each, holding the data table and the result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablescope.schema import quoted
from tablescope.sources.results import STORE_TABLES, create_result_tables

PREFIX = "workflow_"


def workflow_namespace(workflow_id: str) -> str:
    return PREFIX + workflow_id.replace("-", "_").lower()


def create_workflow(spark: SparkSession, workflow_id: str | None = None) -> str:
    """Create the namespace and its empty result tables; returns the workflow id."""
    workflow_id = (workflow_id or str(uuid.uuid4())).replace("-", "_").lower()
    namespace = workflow_namespace(workflow_id)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(namespace)}")
    create_result_tables(spark, namespace)
    return workflow_id


def list_workflows(spark: SparkSession) -> list[str]:
    names = [d.name for d in spark.catalog.listDatabases()]
    return sorted(n.removeprefix(PREFIX) for n in names if n.startswith(PREFIX))


def delete_workflow(spark: SparkSession, workflow_id: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(workflow_namespace(workflow_id))} CASCADE")


def table_exists(spark: SparkSession, namespace: str, table: str) -> tuple[bool, str]:
    if spark.catalog.tableExists(f"{quoted(namespace)}.{quoted(table)}"):
        return True, ""
    return False, f"table {namespace}.{table} does not exist"


def find_data_table(spark: SparkSession, namespace: str) -> str | None:
    """First table of the namespace that is not one of the result tables."""
    names = sorted(t.name for t in spark.catalog.listTables(namespace) if not t.isTemporary)
    return next((n for n in names if n not in STORE_TABLES), None)


def table_scan(spark: SparkSession, namespace: str, table: str) -> DataFrame:
    return spark.table(f"{quoted(namespace)}.{quoted(table)}")


def workflow_sql(spark: SparkSession, namespace: str, statement: str) -> DataFrame:
    """Run a statement with the workflow as the current namespace."""
    previous = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(namespace)
    try:
        return spark.sql(statement)
    finally:
        spark.catalog.setCurrentDatabase(previous)


def fetch(spark: SparkSession, namespace: str, table: str) -> DataFrame:
    """A table of a workflow as a DataFrame; what to bring to the driver is the caller's choice."""
    return spark.table(f"{namespace}.{table}")
