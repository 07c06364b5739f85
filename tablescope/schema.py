"""Column families and the schemas of the result tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the profiler.
MAX_CATEGORICAL_CARDINALITY = 100
TOP_VALUES = 10
BOTTOM_VALUES = 5
PERCENTILES = [5, 10, 25, 50, 75, 90, 95, 99]
IQR_MULTIPLIER = 1.5


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.IntegralType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def is_categorical(data_type: T.DataType) -> bool:
    return is_text(data_type) or isinstance(data_type, T.BooleanType)


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_supported(data_type: T.DataType) -> bool:
    """Types with value statistics; anything else gets null statistics only."""
    return is_numeric(data_type) or is_categorical(data_type) or is_datetime(data_type)


def family(data_type: T.DataType) -> str:
    if is_numeric(data_type):
        return "numeric"
    if is_text(data_type):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "categorical"
    if is_datetime(data_type):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, test) -> list[str]:
    """Names of the columns whose type passes ``test``, in table order."""
    return [f.name for f in df.schema.fields if test(f.dataType)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


EDA_SUMMARY = (
    "analysis_id STRING, table_name STRING, schema_name STRING, database_name STRING, "
    "total_rows BIGINT, total_columns INT, duplicate_rows BIGINT, duplicate_percentage DOUBLE, "
    "target_column STRING, analysis_type STRING, problem_type STRING, created_at TIMESTAMP"
)

EDA_COLUMN_STATS = (
    "analysis_id STRING, column_name STRING, data_type STRING, total_count BIGINT, "
    "null_percentage DOUBLE, unique_count BIGINT, cardinality_ratio DOUBLE, mean_value DOUBLE, "
    "median_value DOUBLE, mode_value STRING, std_dev DOUBLE, min_value STRING, max_value STRING, "
    "q1 DOUBLE, q3 DOUBLE, skewness DOUBLE, outlier_percentage DOUBLE, entropy DOUBLE"
)

TARGET_STATS = (
    "analysis_id STRING, target_column STRING, problem_type STRING, num_classes BIGINT, "
    "majority_class_percentage DOUBLE, minority_class_percentage DOUBLE, balance_ratio DOUBLE, "
    "mean DOUBLE, median DOUBLE, std_dev DOUBLE, min DOUBLE, max DOUBLE, q1 DOUBLE, q3 DOUBLE, "
    "skewness DOUBLE, distribution_shape STRING"
)

TARGET_CLASSES = (
    "analysis_id STRING, target_column STRING, class STRING, count BIGINT, percentage DOUBLE"
)

MODEL_SUMMARY = (
    "analysis_id STRING, workflow_id STRING, table_name STRING, target_variable STRING, "
    "model_type STRING, problem_type STRING, "
    "test_accuracy DOUBLE, test_precision DOUBLE, test_recall DOUBLE, test_f1_score DOUBLE, "
    "test_roc_auc DOUBLE, train_accuracy DOUBLE, train_precision DOUBLE, train_recall DOUBLE, "
    "train_f1_score DOUBLE, "
    "tree_depth INT, n_leaves INT, max_depth INT, min_samples_split INT, min_samples_leaf INT, "
    "n_estimators INT, learning_rate DOUBLE, subsample DOUBLE, colsample_bytree DOUBLE, "
    "total_samples BIGINT, total_features INT, n_classes INT, class_labels ARRAY<STRING>, "
    "performance_summary STRING, top_features_summary STRING, data_quality_summary STRING, "
    "model_config_summary STRING, "
    "confusion_matrix ARRAY<ARRAY<BIGINT>>, "
    "top_features ARRAY<STRUCT<feature: STRING, importance: DOUBLE>>, "
    "feature_importance ARRAY<STRUCT<feature: STRING, importance: DOUBLE>>, "
    "preprocessing_details STRUCT<original_rows: BIGINT, original_features: INT, "
    "dropped_columns: ARRAY<STRING>, encoded_columns: ARRAY<STRING>, "
    "missing_values_handled: BIGINT, rows_dropped: BIGINT, target_conversion: STRING, "
    "final_rows: BIGINT, final_features: INT>, "
    "recommendations ARRAY<STRING>, model_parameters STRING, created_at TIMESTAMP"
)

WORKFLOW_METADATA = ("key STRING, value STRING, updated_at TIMESTAMP")

RESULT_TABLES = {
    "workflow_metadata": WORKFLOW_METADATA,
    "workflow_eda_summary": EDA_SUMMARY,
    "workflow_eda_column_stats": EDA_COLUMN_STATS,
    "workflow_target_stats": TARGET_STATS,
    "workflow_target_classes": TARGET_CLASSES,
    "workflow_model_summary": MODEL_SUMMARY,
}


@cache
def result_schema(table: str) -> T.StructType:
    """Schema of a result table (parsed on first use: parsing needs a running session)."""
    return T.StructType.fromDDL(RESULT_TABLES[table])
