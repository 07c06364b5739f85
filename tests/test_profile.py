"""Hand-computed answers and properties of the profiler."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions import TEXT_PATTERNS, distribution_shape, pearson_skew, round_half_up, safe_divide, truncated
from tablescope.operators import frequency, numeric, quantiles, tables, temporal, text
from tablescope.plans.profile import column_profile, profile_table


def by_column(frame):
    return {r["column_name"]: r for r in frame.collect()}


def test_numeric_fixture(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (100.0,), (None,)], "x double")
    row = by_column(column_profile(df))["x"]
    assert row["null_percentage"] == pytest.approx(16.67, abs=0.01)
    assert row["cardinality_ratio"] == pytest.approx(0.8333, abs=1e-4)
    assert (row["unique_count"], row["mean_value"], row["std_dev"]) == (5, 22.0, 43.62)
    assert (row["q1"], row["median_value"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["outlier_percentage"], row["skewness"]) == (16.67, 1.31)
    assert (row["min_value"], row["max_value"], row["mode_value"]) == ("1", "100", "1")


def test_text_fixture(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    row = frequency.frequency_summary(df).first()
    assert (row["mode_value"], row["entropy"], row["entropy_nonnull"]) == ("a", 1.0, 0.92)
    assert frequency.concentration(df).first()[1] == 75.0


def test_constant_null_and_empty(spark):
    df = spark.createDataFrame([("x", None), ("x", None)], "s string, n double")
    rows = by_column(column_profile(df))
    assert rows["s"]["entropy"] == 0.0 and math.copysign(1, rows["s"]["entropy"]) == 1
    assert rows["n"]["null_percentage"] == 100.0 and rows["n"]["unique_count"] == 0
    assert all(rows["n"][c] is None for c in ("entropy", "mode_value", "q1", "mean_value", "outlier_percentage"))
    empty = by_column(column_profile(df.where("s = 'none'")))
    assert set(empty) == {"s", "n"}
    assert empty["s"]["null_percentage"] == 0.0 and empty["s"]["cardinality_ratio"] == 0.0
    assert tables.duplicate_rows(df.where("s = 'none'")).first()["duplicate_percentage"] == 0.0


def test_types_without_values_get_null_shares(spark):
    df = spark.createDataFrame([([1], {"a": 1}, b"x"), (None, None, None)], "a array<int>, m map<string,int>, b binary")
    rows = by_column(column_profile(df))
    assert all(rows[c]["null_percentage"] == 50.0 and rows[c]["unique_count"] is None for c in "amb")
    assert tables.duplicate_rows(df.unionAll(df)).first()["duplicate_rows"] == 2


def test_duplicates_see_nulls(spark):
    rows = [(1, None), (1, None), (2, "a"), (2, "a"), (3, "b")]
    row = tables.duplicate_rows(spark.createDataFrame(rows, "k int, s string")).first()
    assert (row["duplicate_rows"], row["duplicate_percentage"]) == (2, 40.0)


def test_nan_counts_as_null_in_numbers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    row = numeric.numeric_basic(df).first()
    assert (row["mean_value"], row["max_value"]) == (1.0, 1.0)


def test_long_text_mode_is_the_text_itself(spark):
    long = "word " * 200
    df = spark.createDataFrame([(long,), (long,), ("short",), (long + "!",)], "s string")
    assert frequency.frequency_summary(df).first()["mode_value"] == long
    top = {r["value"]: r["count"] for r in frequency.top_values(df).collect()}
    assert top == {long: 2, "short": 1, long + "!": 1}


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(9, "b"), (10, "a"), (9, "a"), (10, "b")], "x int, s string")
    rows = by_column(frequency.frequency_summary(df))
    assert (rows["x"]["mode_value"], rows["s"]["mode_value"]) == ("9", "a")


def test_bottom_values(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "s string")
    assert [r["value"] for r in frequency.bottom_values(df, limit=2).orderBy("rank").collect()] == ["c", "b"]


def test_approximate_variants(spark, table):
    li = table("lineitem")
    exact = {r["column_name"]: r["unique_count"] for r in frequency.unique_stats(li).collect()}
    for r in frequency.approximate_unique_stats(li).collect():
        assert abs(r["unique_count"] - exact[r["column_name"]]) <= 0.05 * exact[r["column_name"]] + 1
    # approximate in rank: the share of rows up to the value is close to the probability
    for r in numeric.approximate_quantiles(li).collect():
        x = F.col(r["column_name"])
        for p, v in zip((0.25, 0.5, 0.75), r["quantiles"]):
            low, high = li.agg(F.avg((x < v).cast("int")), F.avg((x <= v).cast("int"))).first()
            assert low - 0.001 <= p <= high + 0.001


@pytest.mark.parametrize("values_per_task", [1_000_000, 20, 1])
def test_exact_quantiles(spark, values_per_task):
    rng = np.random.default_rng(7)
    n = 20_000
    skewed = np.where(rng.random(n) < 0.4, 3.0, rng.lognormal(0, 4, n).round(3))
    few = rng.integers(0, 3, n).astype(float)
    df = spark.createDataFrame(list(zip(map(float, skewed), map(float, few))), "a double, b double")
    probs = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, probs, values_per_task=values_per_task)
    assert np.allclose(got["a"], np.quantile(skewed, probs))
    assert np.allclose(got["b"], np.quantile(few, probs))


def test_exact_quantiles_between_two_hot_values(spark):
    """The wanted rank sits among rare values between two values that hold nearly all rows."""
    x = F.when(F.col("id") < 40_000, 3.0).when(F.col("id") < 40_100, 3.0 + F.col("id") / 1e6).otherwise(4.0)
    df = spark.range(80_100).select(x.alias("x"))
    got = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.5], values_per_task=16)
    values = [3.0] * 40_000 + [3.0 + i / 1e6 for i in range(40_000, 40_100)] + [4.0] * 40_000
    assert got["x"][0] == pytest.approx(np.quantile(values, 0.5))


def test_order_statistics_recover_from_a_wrong_sketch(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    wrong = {"x": ([0.0, 1.0], [5.0, 5.0])}
    got = quantiles.order_statistics(
        df, {"x": F.col("x")}, {"x": [0, 5_000, 9_999]}, {"x": 10_000}, wrong, values_per_task=100
    )
    assert got == {("x", 0): 0.0, ("x", 5_000): 5_000.0, ("x", 9_999): 9_999.0}


def test_profile_does_not_depend_on_partitioning(spark, table):
    events = table("events").select("user_id", "event_type", "value")
    few, many = column_profile(events.coalesce(1)).collect(), column_profile(events.repartition(23)).collect()
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_profile_table(spark, table):
    orders = table("orders")
    profile = profile_table(orders, "orders", "here", target="o_orderstatus", exclude=["o_orderkey"])
    summary = profile.summary.first()
    assert (summary["total_columns"], summary["analysis_type"]) == (5, "supervised")
    assert profile.column_stats.count() == 5
    assert profile.target_stats.first()["num_classes"] == 3
    assert profile.target_classes.count() == 3
    with pytest.raises(ValueError, match="excluded"):
        profile_table(orders, "orders", target="o_orderkey", exclude=["o_orderkey"])
    with pytest.raises(ValueError, match="not in the table"):
        profile_table(orders, "orders", target="nothing")


def test_dates(spark):
    day = datetime.date
    df = spark.createDataFrame([(day(2024, 1, 1),), (day(2024, 1, 1),), (day(2024, 1, 5),)], "d date")
    assert temporal.date_range(df, "d").first()["date_range_days"] == 4
    assert temporal.largest_gap(df, "d").first()[0] == 4
    assert temporal.largest_gap(df.where("d < '2024-01-02'"), "d").first()[0] == 0
    assert temporal.largest_gap(df.where("d > '2024-01-02'"), "d").first()[0] is None
    sunday = spark.createDataFrame([(day(2024, 1, 7),)], "d date")
    assert temporal.by_day_of_week(sunday, "d").first()["day"] == 0


def test_text_patterns(spark):
    values = ["me@site.org", "+1 (234) 567-8901", "https://a.b/c", "123", "12345678", "abc1", "a b", "  ", None]
    row = text.pattern_counts(spark.createDataFrame([(v,) for v in values], "s string")).first()
    assert [row[p] for p in TEXT_PATTERNS] == [1, 2, 1, 1, 1]


def test_scalar_helpers(spark):
    row = spark.range(1).select(
        safe_divide(F.lit(1), F.lit(0)).alias("zero"),
        safe_divide(F.lit(None), F.lit(2)).alias("null"),
        round_half_up(F.lit(2.675)).alias("half"),
        round_half_up(F.lit(float("nan"))).alias("nan"),
        truncated(F.lit("x" * 1001)).alias("cut"),
        truncated(F.lit(None).cast("string")).alias("none"),
        pearson_skew(F.lit(22.0), F.lit(3.0), F.lit(0.0)).alias("flat"),
        distribution_shape(F.lit(-1.2)).alias("left"),
        distribution_shape(F.lit(1.0)).alias("right"),
    ).first()
    assert (row["zero"], row["null"], row["half"], row["nan"]) == (0.0, 0.0, 2.68, None)
    assert row["cut"] == "x" * 1000 + "..." and row["none"] == ""
    assert (row["flat"], row["left"], row["right"]) == (None, "left_skewed", "moderately_right_skewed")


def test_entropy_bound(spark, table):
    for r in frequency.frequency_summary(table("lineitem")).collect():
        assert r["entropy"] <= math.log2(r["unique_count"]) + 0.01


def test_plans_stay_narrow(spark, table):
    """The value scan reads only its columns, and top-k is cut before the shuffle."""
    li = table("lineitem")
    plan = frequency.top_values(li, ["l_suppkey", "l_partkey"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan or "l_extendedprice" not in plan.split("== Physical Plan ==")[1]


def test_ties_of_texts_of_255_to_257_characters(spark):
    """One order for all lengths: by text, only longer ones with the same first 256 characters go by digest."""
    texts = [c * n for n in (3, 255, 256, 257, 300) for c in "ba"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["value"] for r in frequency.top_values(df, limit=20).orderBy("rank").collect()]
    key = lambda t: t if len(t) <= 256 else t[:256] + hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted(texts, key=key)
    assert got[:3] == ["aaa", "a" * 255, "a" * 256] and frequency.frequency_summary(df).first()["mode_value"] == "aaa"


def test_duplicates_by_digest(spark):
    """Nulls, neighbours that run together, zeros of both signs, NaN, nested and binary cells."""
    rows = [
        ("ab", "c", 0.0, [1], b"x"), ("ab", "c", -0.0, [1], b"x"), ("a", "bc", 0.0, [1], b"x"), (None, "c", float("nan"), None, None),
        (None, "c", float("nan"), None, None), ("-", "c", float("nan"), None, None), ("", None, None, [], b""), (None, "", None, [None], b""),
    ]
    df = spark.createDataFrame(rows, "a string, b string, x double, l array<int>, z binary")
    row = tables.duplicate_rows(df).first()
    assert (row["total_rows"], row["duplicate_rows"]) == (8, 2)
    assert tables.duplicate_rows(df.where("false")).first()["duplicate_rows"] == 0


def test_pairs_are_counted_before_the_shuffle(spark, monkeypatch):
    """Rows of all different kinds leave a task as cells and their counts, also cut into many pieces."""
    from tablescope.operators import association

    monkeypatch.setattr(association, "ROWS_AT_ONCE", 700)
    rng = np.random.default_rng(3)
    values = rng.normal(size=(4000, 3))
    rows = [(*map(float, v), "ab"[i % 2] if i % 5 else None, i % 3) for i, v in enumerate(values)]
    rows[7] = (None, float("nan"), *rows[7][2:])
    df = spark.createDataFrame(rows, "a double, b double, c double, s string, i int").coalesce(1)
    names = df.columns
    coded, edges = association.coded_columns(df, names, dict(zip(names, [4000, 4000, 4000, 2, 3])))
    assert list(edges) == [0, 1, 2]
    cells = association.pair_counts(coded, edges)
    found = {}
    for r in cells.collect():
        found.setdefault(divmod(r["pair"], 5), []).append(r["n"])
    assert len(found) == 15 and all(sum(n) == 4000 for n in found.values())
    assert sorted(found[0, 0]) == [1, 399] + [400] * 9 and sorted(found[3, 4]) == sorted(
        np.unique([f"{r[3]}{r[4]}" for r in rows], return_counts=True)[1].tolist()
    )
    partial = cells.groupBy().count()  # what is shuffled: at most 12 x 12 cells of each pair and piece
    assert sum(len(n) for n in found.values()) < 15 * 145 and partial.first()[0] < 15 * 145
    got = {(r["column_name"], r["partner"]): r["association"] for r in association.associations(df).collect()}
    assert len(got) == 20 and got["a", "b"] == got["b", "a"] < 0.05


def test_places_in_ranges_are_those_of_the_expression(spark):
    nan, inf = float("nan"), float("inf")
    values = [-inf, -1.0, -0.0, 0.0, 0.5, 1.0, 2.0, 2.5, 3.0, 4.0, inf, nan]
    for ranges in ([(0.0, 1.0), (2.0, 2.0), (3.0, 4.0)], [(-1.0, 0.5), (4.0, nan)], [(nan, nan)]):
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        expected = [r[0] for r in frame.select(quantiles._slot(F.col("x"), ranges)).collect()]
        low, high = np.array(ranges, float).T
        assert quantiles._places(np.array(values), low, high).tolist() == expected, ranges
