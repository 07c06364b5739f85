"""Feature preparation: decide on the driver from small statistics, apply as one projection.

``fit_features`` looks at the table with a handful of aggregates and returns a ``FeaturePlan``
(names, medians, code lists: as small as the schema).  ``apply_features`` turns any frame into
numeric feature columns plus ``label`` without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import schema as S
from tablescope.operators.frequency import unique_stats
from tablescope.operators.numeric import as_double
from tablescope.operators.lookup import look_up
from tablescope.operators.ordering import totals_before
from tablescope.operators.quantiles import exact_quantiles
from tablescope.operators.target import require_column
from tablescope.session import checkpointed

# Fixed values of the preparation.
MAX_MISSING = 0.5
MISSING = "MISSING"
MAX_CATEGORIES = {"logistic_regression": 50, "decision_tree": 100, "gradient_boosting": 200}
FEW_CLASSES = 10
MANY_CLASSES = 50
BIN_LABELS = ["High", "Low", "Medium"]  # the three bins in code order
MOST_VALUES = 10_000  # distinct values of a column whose list goes through the driver
LABELS_SHOWN = 10_000  # classes that reports list by name


class DegenerateBins(ValueError):
    """The tertiles of the target coincide, so three bins cannot be formed."""


@dataclass
class FeaturePlan:
    target: str
    original_rows: int = 0
    original_features: int = 0
    rows_dropped: int = 0
    dropped: list[str] = field(default_factory=list)
    decisions: dict[str, str] = field(default_factory=dict)
    encoded: dict[str, list[str]] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    missing_values_handled: int = 0
    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)
    target_conversion: str = ""
    labels: list[str] | None = None
    edges: tuple[float, float] | None = None
    label_codes: DataFrame | None = None
    shown: dict[str, str] = field(default_factory=dict)  # names for reports, where they differ
    features: list[str] = field(default_factory=list)
    n_classes: int = 0

    def drop(self, column: str, code: str, reason: str) -> None:
        column = self.shown.get(column, column)
        self.dropped.append(f"{column} ({reason})")
        self.decisions[column] = code

    def in_shown_names(self) -> FeaturePlan:
        """The plan as reports show it."""
        name = lambda c: self.shown.get(c, c)
        by_name = lambda d: {name(c): v for c, v in d.items()}
        return replace(
            self, target=name(self.target), encoded=by_name(self.encoded), numeric=[*map(name, self.numeric)],
            medians=by_name(self.medians), scaling=by_name(self.scaling), features=[*map(name, self.features)], shown={},
        )

    @property
    def final_rows(self) -> int:
        return self.original_rows - self.rows_dropped


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    require_column(df, target)
    return df.where(~is_missing(df, target))


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or a NaN or infinity of a floating column."""
    if S.is_numeric(df.schema[column].dataType):
        return as_double(df, column).isNull()
    return F.col(S.quoted(column)).isNull()


def _text(df: DataFrame, name: str) -> Column:
    """String form used for codes; booleans read True / False."""
    value = F.col(S.quoted(name))
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(value.cast("string"))
    return value.cast("string")


def _position(value: Column, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), value) - 1


def label_encode(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Add ``<column>_code``: the place of the value in its ascending list, null as MISSING."""
    codes = [
        _position(F.coalesce(_text(df, c), F.lit(MISSING)), values).alias(f"{c}_code")
        for c, values in columns.items()
    ]
    return df.select("*", *codes)


def code_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, value, code) for all values of the columns by place, codes 0..k-1 in ascending order, null as MISSING."""
    cells = [F.struct(F.lit(i).alias("c"), F.coalesce(_text(df, c), F.lit(MISSING)).alias("value")) for i, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*cells))).distinct()
    return totals_before(values, ["value"], {"code": F.lit(1)}, within=["c"])


def label_encode_by_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """As ``label_encode`` with any number of values: the codes are a table and are joined, column by column."""
    table = checkpointed(code_table(df, columns))
    sizes = {r["c"]: r["count"] for r in table.groupBy("c").count().collect()}
    names = df.columns
    for i, c in enumerate(columns):
        facts = table.where(F.col("c") == i).select(F.col("value").alias("of"), (F.col("code") * 1).alias(f"{c}_code"))
        df = look_up(df, F.coalesce(_text(df, c), F.lit(MISSING)), facts, sizes.get(i, 0))
    return df.select(*map(S.quoted, names), *[F.col(S.quoted(f"{c}_code")).cast("int").alias(f"{c}_code") for c in columns])


def category_values(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Ascending values of each column, MISSING standing for null; at most MOST_VALUES, counted before."""
    if not columns:
        return {}
    for r in unique_stats(df, columns).collect():
        if r["unique_count"] > MOST_VALUES:
            raise ValueError(f"column {r['column_name']!r} has {r['unique_count']} distinct values; use label_encode_by_table")
    return _listed_values(df, columns)


def _listed_values(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The lists of columns whose distinct values were counted."""
    if not columns:
        return {}
    sets = [F.collect_set(F.coalesce(_text(df, c), F.lit(MISSING))).alias(f"v{i}") for i, c in enumerate(columns)]
    row = df.agg(*sets).first()
    return {c: sorted(row[f"v{i}"], key=lambda v: v.encode()) for i, c in enumerate(columns)}


def missing_shares(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Rows and missing cells per column (one aggregate)."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    return row["rows"], {c: row[f"m{i}"] for i, c in enumerate(columns)}


def tertile_edges(df: DataFrame, column: str) -> tuple[float, float]:
    low, high = exact_quantiles(df, {column: as_double(df, column)}, [1 / 3, 2 / 3])[column]
    row = df.agg(F.min(as_double(df, column)), F.max(as_double(df, column))).first()
    _check_edges(column, (row[0], row[1]), (low, high))
    return low, high


def _check_edges(column: str, ends: tuple, edges: tuple) -> None:
    if len({*ends, *edges}) < 4:
        raise DegenerateBins(f"column {column!r} is too concentrated for three quantile bins")


def quantile_bin3(value: Column, edges: tuple[float, float]) -> Column:
    """Low / Medium / High with right-closed bins."""
    return F.when(value <= F.lit(edges[0]), "Low").when(value <= F.lit(edges[1]), "Medium").when(value.isNotNull(), "High")


def median_impute(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float], int]:
    """Fill numeric nulls with the exact median; also the medians and the filled cells."""
    rows, missing = missing_shares(df, columns)
    gaps = [c for c in columns if missing[c]]
    medians = exact_quantiles(df, {c: as_double(df, c) for c in gaps}, [0.5]) if gaps else {}
    values = {c: m[0] for c, m in medians.items() if m is not None}
    filled = df.withColumns(
        {c: F.coalesce(as_double(df, c), F.lit(values[c])) for c in values}
    )
    return filled, values, sum(missing[c] for c in values)


def scaling_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (one aggregate)."""
    exprs = []
    for i, c in enumerate(columns):
        exprs += [F.avg(S.quoted(c)).alias(f"m{i}"), F.stddev_pop(S.quoted(c)).alias(f"s{i}")]
    row = df.agg(*exprs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0."""
    return df.withColumns(
        {
            c: (F.col(S.quoted(c)) - F.lit(mean)) / F.lit(std) if std else F.col(S.quoted(c)) - F.lit(mean)
            for c, (mean, std) in scaling.items()
        }
    )


def fit_features(
    df: DataFrame, target: str, max_categories: int = 50, scale: bool = False, fit_on: Column | None = None,
    shown: dict[str, str] | None = None,
) -> FeaturePlan:
    """Choose and parameterise the features of ``df``.

    ``fit_on`` restricts code lists, medians, scaling and bins to e.g. the training rows; by
    default they see all rows.  ``shown`` has the names for reports, where columns go by others.
    """
    return fit_plans(df, target, [(max_categories, scale)], fit_on, shown)[0]


def fit_plans(
    df: DataFrame, target: str, kinds: list[tuple[int, bool]], fit_on: Column | None = None, shown: dict[str, str] | None = None
) -> list[FeaturePlan]:
    """``fit_features`` for each (max_categories, scale) of ``kinds``, from one look at the table."""
    require_column(df, target)
    common = FeaturePlan(target, original_features=len(df.columns) - 1, shown=shown or {})
    names = [c for c in df.columns if c != target]
    base = base_statistics(df, target, names, fit_on)
    common.original_rows, common.rows_dropped = base["rows"], base["null_targets"]
    rows = drop_null_target(df, target)
    if fit_on is not None:
        rows = rows.where(fit_on)

    count, missing = base["used"], base["missing"]
    usable = []
    for c in names:
        if count and missing[c] / count > MAX_MISSING:
            common.drop(c, "sparse", f"{missing[c] / count:.1%} missing")
        else:
            usable.append(c)
    for c in list(usable):
        data_type = df.schema[c].dataType
        if S.is_datetime(data_type):
            common.drop(c, "datetime", "datetime")
            usable.remove(c)
        elif not S.is_supported(data_type):
            common.drop(c, "unsupported", "unsupported type")
            usable.remove(c)

    def is_category(c: str) -> bool:
        boolean = isinstance(df.schema[c].dataType, T.BooleanType)
        return S.is_text(df.schema[c].dataType) or (boolean and missing[c] > 0)

    # distinct values of all candidates and of the target, from one frequency count
    categories = [c for c in usable if is_category(c)]
    unique = {r["column_name"]: r["unique_count"] for r in unique_stats(rows, [*categories, target]).collect()}
    most = max(limit for limit, _ in kinds)
    frequencies = listed_frequencies(rows, [c for c in categories if unique[c] <= most])

    common.numeric = [c for c in usable if c not in categories]
    gaps = [c for c in common.numeric if missing[c]]
    binned = S.is_numeric(df.schema[target].dataType) and unique[target] > MANY_CLASSES
    # medians and the target's tertiles are one search for order statistics
    wanted = {c: as_double(rows, c) for c in [*gaps, *([target] if binned else [])]}
    found = exact_quantiles(rows, wanted, [1 / 3, 0.5, 2 / 3]) if wanted else {}
    common.medians = {c: found[c][1] for c in gaps if found[c] is not None}
    common.missing_values_handled = sum(missing[c] for c in gaps)
    edges = None
    if binned:
        edges = found[target][0], found[target][2]
        _check_edges(target, base["target_range"], edges)
    _fit_target(rows, common, unique[target], edges)

    plans = []
    for limit, scale in kinds:
        plan = replace(common, dropped=[*common.dropped], decisions={**common.decisions})
        for c in categories:
            if unique[c] > limit:
                plan.drop(c, "high_cardinality", f"high cardinality: {unique[c]} unique values")
        plan.encoded = {c: list(own) for c, own in frequencies.items() if unique[c] <= limit}
        plan.features = [c for c in usable if c not in categories or c in plan.encoded]
        plan.decisions.update({plan.shown.get(c, c): "encoded" if c in plan.encoded else "numeric" for c in plan.features})
        if scale:
            plan.scaling = {c: _scaling_of(c, plan, base, frequencies) for c in plan.features}
        plans.append(plan)
    return plans


def base_statistics(df: DataFrame, target: str, names: list[str], fit_on: Column | None = None) -> dict:
    """Rows, null targets, and over the rows that count: missing cells, means and variances. One aggregate."""
    used = ~is_missing(df, target)
    if fit_on is not None:
        used = used & F.coalesce(fit_on, F.lit(False))
    exprs = [F.count(F.lit(1)).alias("rows"), F.count_if(is_missing(df, target)).alias("null_targets"), F.count_if(used).alias("used")]
    numbers = [i for i, c in enumerate(names) if S.is_numeric(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType)]
    for i, c in enumerate(names):
        exprs.append(F.count_if(used & is_missing(df, c)).alias(f"m{i}"))
    for i in numbers:
        value = F.when(used, as_double(df, names[i]))
        exprs += [F.avg(value).alias(f"a{i}"), F.var_pop(value).alias(f"v{i}")]
    if S.is_numeric(df.schema[target].dataType):
        value = F.when(used, as_double(df, target))
        exprs += [F.min(value).alias("low"), F.max(value).alias("high")]
    row = df.agg(*exprs).first().asDict()
    return {
        "rows": row["rows"], "null_targets": row["null_targets"], "used": row["used"],
        "missing": {c: row[f"m{i}"] for i, c in enumerate(names)},
        "moments": {names[i]: (row[f"a{i}"], row[f"v{i}"]) for i in numbers},
        "target_range": (row.get("low"), row.get("high")),
    }


def listed_frequencies(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Rows per value, ascending by value, of columns whose distinct values were counted; null is MISSING."""
    if not columns:
        return {}
    cells = [F.struct(F.lit(i).alias("c"), F.coalesce(_text(df, c), F.lit(MISSING)).alias("value")) for i, c in enumerate(columns)]
    counted = df.select(F.inline(F.array(*cells))).groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))
    found: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in sorted(counted.collect(), key=lambda r: (r["c"], r["value"].encode())):
        found[columns[r["c"]]][r["value"]] = r["n"]
    return found


def _scaling_of(column: str, plan: FeaturePlan, base: dict, frequencies: dict) -> tuple[float | None, float | None]:
    """Mean and population deviation of a feature after encoding and imputing, from the statistics at hand."""
    if column in frequencies:
        counts = list(frequencies[column].values())
        total = sum(counts)
        if not total:
            return None, None
        mean = sum(i * n for i, n in enumerate(counts)) / total
        return mean, math.sqrt(sum(n * (i - mean) ** 2 for i, n in enumerate(counts)) / total)
    mean, variance = base["moments"][column]
    if mean is None:
        return None, None
    filled = base["missing"][column] if column in plan.medians else 0
    known = base["used"] - base["missing"][column]
    value = plan.medians.get(column, 0.0)
    whole = (known * mean + filled * value) / (known + filled)
    spread = (known * (variance + (mean - whole) ** 2) + filled * (value - whole) ** 2) / (known + filled)
    return whole, math.sqrt(spread)


def target_policy(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How each column would be turned into classes if it were the target."""
    stats = unique_stats(df, columns)
    numeric = F.col("column_name").isin(*[c for c in df.columns if S.is_numeric(df.schema[c].dataType)])
    distinct = F.col("unique_count")
    policy = (
        F.when(~numeric, "categorical_encoded")
        .when(distinct <= FEW_CLASSES, "numeric_categorical")
        .when(distinct > MANY_CLASSES, "continuous_to_3_classes")
        .otherwise("numeric_as_is")
    )
    return stats.select("column_name", "unique_count", policy.alias("target_policy"))


def column_decisions(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """(column_name, decision): kept as numeric or encoded, or why it was dropped."""
    return df.sparkSession.createDataFrame(list(plan.decisions.items()), "column_name string, decision string")


def _fit_target(rows: DataFrame, plan: FeaturePlan, distinct: int, edges: tuple[float, float] | None) -> None:
    """Codes of the target: categories, numeric classes as they are, or three quantile bins."""
    target, data_type = plan.target, rows.schema[plan.target].dataType
    if edges is not None:
        plan.target_conversion = "continuous_to_3_classes (Low, Medium, High)"
        plan.edges, plan.labels, plan.n_classes = edges, list(BIN_LABELS), len(BIN_LABELS)
        return
    if not S.is_numeric(data_type):
        plan.target_conversion = "categorical_encoded"
    elif distinct <= FEW_CLASSES:
        plan.target_conversion = f"numeric_categorical ({distinct} classes)"
    else:
        plan.target_conversion = f"numeric_as_is ({distinct} classes)"
    plan.n_classes = distinct
    # the codes are a table for any number of classes; numbers go by value, everything else by text
    text = _text(rows, target).alias("of")
    order = [F.col(S.quoted(target)).alias("value")] if S.is_numeric(data_type) else []
    values = rows.select(text, *order).distinct()
    coded = totals_before(values, ["value"] if order else ["of"], {"code": F.lit(1)})
    plan.label_codes = checkpointed(coded.select("of", F.col("code").cast("double").alias("__label")))
    if distinct <= LABELS_SHOWN:
        plan.labels = [r["of"] for r in plan.label_codes.orderBy("__label").collect()]


def feature_columns(df: DataFrame, plan: FeaturePlan, keep: list[str] | None = None) -> DataFrame:
    """Encoded and imputed features as doubles, before scaling, plus the ``keep`` columns."""
    columns = []
    for c in plan.features:
        if c in plan.encoded:
            code = _position(F.coalesce(_text(df, c), F.lit(MISSING)), plan.encoded[c])
            columns.append(code.cast("double").alias(c))
            continue
        value = as_double(df, c)
        if c in plan.medians:
            value = F.coalesce(value, F.lit(plan.medians[c]))
        columns.append(value.alias(c))
    kept = [F.col(S.quoted(c)) for c in (keep or []) if c not in plan.features]
    return df.select(*kept, *columns)


def with_label(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """The usable rows with the target's code (0..k-1) as ``__label``; all columns stay as they are."""
    rows = drop_null_target(df, plan.target)
    if plan.edges is not None:
        label = _position(quantile_bin3(as_double(rows, plan.target), plan.edges), plan.labels)
        return rows.withColumn("__label", label.cast("double"))
    return look_up(rows, _text(rows, plan.target), plan.label_codes, plan.n_classes)


def scaled_features(df: DataFrame, plan: FeaturePlan, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns and the encoded, imputed and scaled features."""
    return standard_scale(feature_columns(df, plan, keep), plan.scaling)


def apply_features(df: DataFrame, plan: FeaturePlan, keep: list[str] | None = None) -> DataFrame:
    """Feature columns, ``label`` (codes 0..k-1) and the ``keep`` columns of the usable rows."""
    if "label" in plan.features:
        raise ValueError("a feature is called 'label'; rename it, or use with_label and scaled_features")
    rows = with_label(df, plan)
    return scaled_features(rows, plan, [*(keep or []), "__label"]).withColumnRenamed("__label", "label")


def assemble_features(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Pack the feature columns into the vector column MLlib reads."""
    assembler = VectorAssembler(inputCols=plan.features, outputCol="features", handleInvalid="error")
    return assembler.transform(df).drop(*plan.features)


def preprocessing_report(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """The preparation as one row."""
    details = S.result_schema("workflow_model_summary")["preprocessing_details"].dataType
    return df.sparkSession.createDataFrame([report_row(plan)], details)


def report_row(plan: FeaturePlan) -> tuple:
    return (
        plan.original_rows,
        plan.original_features,
        plan.dropped,
        list(plan.encoded),
        plan.missing_values_handled,
        plan.rows_dropped,
        plan.target_conversion,
        plan.final_rows,
        len(plan.features),
    )
