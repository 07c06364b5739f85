"""The result store: append-only logs, one commit per change, and views of what is committed.

No row is ever rewritten. A change of any number of tables writes its rows to their logs under a new commit
id, and counts once that id stands in the table of commits, which is written last; until then no reader sees
any of it. Results are added by rows of kind ``put``; an analysis is removed by a ``delete`` row, which hides
what was committed up to then; a chosen target is a ``target`` row for the analyses so far; of metadata the
newest row of a key counts. So writers never lose each other's changes, and nothing is read while it is
overwritten. A result table as users know it is a view over its log; a reader that keeps the list of commits
it began with (``committed``, ``results_at``) sees the same rows however many writers follow.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.schema import RESULT_TABLES, quoted, result_schema

COMMITS = "workflow_commits"
LOG = "workflow_log_"  # before the name of a result table
#: Everything the store keeps in a namespace; no table of data may be called like these.
STORE_TABLES = [COMMITS, *[LOG + t for t in RESULT_TABLES], *RESULT_TABLES]


def _name(namespace: str, table: str) -> str:
    return f"{quoted(namespace)}.{quoted(table)}"


def current_rows_sql(namespace: str, table: str, commits: str | None = None) -> str:
    """SELECT of a result table's rows; ``commits`` is a relation in place of all commits."""
    names = [f.name for f in result_schema(table).fields]
    log = f"""(SELECT l.*, c.at AS __at FROM {_name(namespace, LOG + table)} l JOIN {commits or _name(namespace, COMMITS)} c ON l.__commit = c.commit)"""
    if table == "workflow_metadata":
        newest = "struct(updated_at, __at, __commit)"
        return f"SELECT key, max_by(value, {newest}) AS value, max_by(updated_at, {newest}) AS updated_at FROM {log} GROUP BY key"
    shown = {n: f"r.{quoted(n)}" for n in names}
    joins = f"""LEFT JOIN (SELECT analysis_id AS of, max(__at) AS at FROM {log} WHERE __kind = 'delete' GROUP BY analysis_id) d
        ON r.analysis_id <=> d.of AND r.__at <= d.at"""
    if table == "workflow_eda_summary":
        joins += f""" LEFT JOIN (SELECT table_name AS of, max(__at) AS at, max_by(struct(target_column, problem_type), struct(__at, __commit)) AS choice
            FROM {log} WHERE __kind = 'target' GROUP BY table_name) t ON r.table_name = t.of AND r.__at <= t.at"""
        for n in ("target_column", "problem_type"):
            shown[n] = f"IF(t.of IS NULL, r.{n}, t.choice.{n})"
    columns = ", ".join(f"{v} AS {quoted(n)}" for n, v in shown.items())
    return f"SELECT {columns} FROM {log} r {joins} WHERE r.__kind = 'put' AND d.at IS NULL"


def create_result_tables(spark: SparkSession, namespace: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(namespace, COMMITS)} (commit STRING, at TIMESTAMP) USING parquet")
    for table, ddl in RESULT_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(namespace, LOG + table)} ({ddl}, __kind STRING, __commit STRING) USING parquet")
        spark.sql(f"CREATE VIEW IF NOT EXISTS {_name(namespace, table)} AS {current_rows_sql(namespace, table)}")


def drop_result_tables(spark: SparkSession, namespace: str, confirm: bool = False) -> list[str]:
    """Drop the result tables; does nothing without ``confirm``."""
    if not confirm:
        return []
    for table in RESULT_TABLES:
        spark.sql(f"DROP VIEW IF EXISTS {_name(namespace, table)}")
        spark.sql(f"DROP TABLE IF EXISTS {_name(namespace, LOG + table)}")
    spark.sql(f"DROP TABLE IF EXISTS {_name(namespace, COMMITS)}")
    return list(RESULT_TABLES)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in schema order, missing ones null, types cast."""
    columns = []
    for f in schema.fields:
        value = F.col(quoted(f.name)) if f.name in df.columns else F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def write_change(df: DataFrame, namespace: str, table: str, commit: str, kind: str = "put") -> None:
    """Add rows to a table's log under a commit that readers don't know yet."""
    rows = conform(df, result_schema(table)).withColumns({"__kind": F.lit(kind), "__commit": F.lit(commit)})
    rows.write.mode("append").insertInto(_name(namespace, LOG + table))


def publish(spark: SparkSession, namespace: str, commit: str) -> None:
    """Make all rows of a commit count, at once."""
    row = spark.range(1).select(F.lit(commit).alias("commit"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").insertInto(_name(namespace, COMMITS))
    for table in [COMMITS, *[LOG + t for t in RESULT_TABLES]]:
        spark.catalog.refreshTable(_name(namespace, table))


def new_commit() -> str:
    return uuid.uuid4().hex


def append_results(df: DataFrame, namespace: str, table: str) -> str:
    """Add rows to a result table as one commit; returns its id."""
    commit = new_commit()
    write_change(df, namespace, table, commit)
    publish(df.sparkSession, namespace, commit)
    return commit


def committed(spark: SparkSession, namespace: str) -> list[str]:
    """The commits so far: what a reader keeps to see one state (a short list, one entry per change)."""
    return [r["commit"] for r in spark.table(_name(namespace, COMMITS)).orderBy("at", "commit").collect()]


def results_at(spark: SparkSession, namespace: str, table: str, commits: list[str]) -> DataFrame:
    """A result table as of the given commits."""
    listed = ", ".join(f"'{c}'" for c in commits) or "''"
    return spark.sql(current_rows_sql(namespace, table, f"(SELECT * FROM {_name(namespace, COMMITS)} WHERE commit IN ({listed}))"))


def save_summary(summary: DataFrame, namespace: str) -> None:
    stamped = summary if "created_at" in summary.columns else summary.withColumn("created_at", F.current_timestamp())
    append_results(stamped, namespace, "workflow_eda_summary")


def save_column_stats(stats: DataFrame, namespace: str) -> None:
    append_results(stats, namespace, "workflow_eda_column_stats")


def save_model_summary(runs: DataFrame, namespace: str) -> None:
    append_results(runs, namespace, "workflow_model_summary")


def get_summary(summaries: DataFrame, analysis_id: str) -> DataFrame:
    return summaries.where(F.col("analysis_id") == analysis_id)


def get_column_stats(stats: DataFrame, analysis_id: str) -> DataFrame:
    return stats.where(F.col("analysis_id") == analysis_id).orderBy("column_name")


def latest_analysis(summaries: DataFrame, table_name: str) -> DataFrame:
    """The newest analysis of a table (ids break ties of the time stamp)."""
    own = summaries.where(F.col("table_name") == table_name)
    return own.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(1)


def list_analyses(summaries: DataFrame, table_name: str | None = None, limit: int = 10) -> DataFrame:
    own = summaries if table_name is None else summaries.where(F.col("table_name") == table_name)
    return own.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(limit)


def without_analysis(frame: DataFrame, analysis_id: str) -> DataFrame:
    return frame.where(~F.col("analysis_id").eqNullSafe(analysis_id))


def delete_analysis(spark: SparkSession, namespace: str, analysis_id: str) -> None:
    """Hide all rows that an analysis has so far in any table, in one commit."""
    gone = spark.range(1).select(F.lit(analysis_id).alias("analysis_id"))
    commit = new_commit()
    for table in ("workflow_eda_column_stats", "workflow_target_classes", "workflow_target_stats", "workflow_eda_summary"):
        write_change(gone, namespace, table, commit, "delete")
    publish(spark, namespace, commit)


def merge_metadata(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by key: the newest row per key wins, a change wins over an equally old row."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    newest = F.struct("updated_at", "__new", "value")
    return both.groupBy("key").agg(F.max(newest).alias("row")).select("key", "row.value", "row.updated_at")


def put_metadata(spark: SparkSession, namespace: str, key: str, value: Column) -> None:
    """Write one metadata entry; ``value`` becomes JSON text."""
    change = spark.range(1).select(
        F.lit(key).alias("key"), F.to_json(value).alias("value"), F.current_timestamp().alias("updated_at")
    )
    append_results(change, namespace, "workflow_metadata")


def with_selected_target(summaries: DataFrame, table_name: str, target: str, problem_type: str) -> DataFrame:
    """Record the chosen target on every analysis of the table."""
    mine = F.col("table_name") == table_name
    return summaries.withColumns(
        {
            "target_column": F.when(mine, F.lit(target)).otherwise(F.col("target_column")),
            "problem_type": F.when(mine, F.lit(problem_type)).otherwise(F.col("problem_type")),
        }
    )


def select_target(
    spark: SparkSession, namespace: str, table_name: str, target: str, problem_type: str, score: int | None = None
) -> None:
    """Write the choice for the summaries so far and into the workflow metadata, in one commit."""
    choice = F.struct(
        F.lit(target).alias("variable"),
        F.lit(table_name).alias("table"),
        F.lit(problem_type).alias("type"),
        F.lit(score).cast("int").alias("score"),
    )
    row = spark.range(1).select(
        F.lit(table_name).alias("table_name"), F.lit(target).alias("target_column"), F.lit(problem_type).alias("problem_type"),
        F.lit("target_variable").alias("key"), F.to_json(choice).alias("value"), F.current_timestamp().alias("updated_at"),
    )
    commit = new_commit()
    write_change(row, namespace, "workflow_eda_summary", commit, "target")
    write_change(row, namespace, "workflow_metadata", commit)
    publish(spark, namespace, commit)


def list_model_results(runs: DataFrame, model_type: str | None = None, table_name: str | None = None) -> DataFrame:
    """Runs newest first, optionally of one family or one table."""
    if model_type is not None:
        runs = runs.where(F.col("model_type") == model_type)
    if table_name is not None:
        runs = runs.where(F.col("table_name") == table_name)
    return runs.orderBy(F.desc("created_at"), F.desc("analysis_id"))


def newest_per(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key combination."""
    w = W.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("analysis_id"))
    return frame.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")
