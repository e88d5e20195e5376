"""Profiles, frequencies and quantiles on hand-made frames."""

from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.operators.frequency import distinct_counts, frequencies
from tablescout.operators.profile import (
    column_overview,
    column_profile,
    column_stats,
    table_profile,
    top_values,
)
from tablescout.operators import quantiles, sketches
from tablescout.operators.quantiles import column_quantiles


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string, c timestamp_ntz, d double")
    stats = by_column(column_overview({"t": empty}))
    assert {r["row_count"] for r in stats.values()} == {0}
    assert {r["null_pct"] for r in stats.values()} == {0.0}
    assert stats["a"]["numeric_role"] == "measure"
    assert table_profile({"t": empty}).first()["duplicate_pct"] == 0.0
    assert column_quantiles({"t": empty}, {"p50": 0.5}).count() == 0


def test_single_row_has_no_deviation(spark):
    one = spark.createDataFrame([(5, "x")], "a int, b string")
    stats = by_column(column_stats({"t": one}))
    assert stats["a"]["std_value"] == 0.0
    assert stats["a"]["mean_value"] == 5.0
    assert column_quantiles({"t": one}, {"p5": 0.05, "p95": 0.95}).first()[2:] == (5.0, 5.0)


def test_all_missing_column(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    row = by_column(column_overview({"t": df}))["a"]
    assert (row["null_count"], row["distinct_count"], row["mean_value"]) == (2, 0, None)
    assert row["numeric_role"] == "measure"


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "a double")
    row = by_column(column_overview({"t": df}))["a"]
    assert (row["null_count"], row["distinct_count"], row["max_value"]) == (2, 1, 1.0)
    assert table_profile({"t": df}).first()["distinct_rows"] == 2


def test_duplicate_rows_tell_null_positions_apart(spark):
    df = spark.createDataFrame(
        [(None, "a"), ("a", None), ("a", None), (None, None)], "x string, y string"
    )
    row = table_profile({"t": df}).first()
    assert (row["row_count"], row["distinct_rows"], row["duplicate_pct"]) == (4, 3, 0.25)


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert table_profile({"t": df}).first()["distinct_rows"] == 1
    assert by_column(distinct_counts({"t": df}))["a"]["distinct_count"] == 1


def test_big_integers_keep_their_digits(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "a bigint")
    assert distinct_counts({"t": df}).first()["distinct_count"] == 2


def test_array_columns_only_count_missing(spark):
    df = spark.createDataFrame([([1.0],), (None,)], "v array<float>")
    row = column_stats({"t": df}).first()
    assert (row["family"], row["null_count"], row["row_count"]) == ("other", 1, 2)


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "it's")], "`a.b c` int, `q'` string")
    stats = by_column(column_overview({"t": df}))
    assert stats["a.b c"]["max_value"] == 2.0
    assert stats["q'"]["distinct_count"] == 2
    assert column_quantiles({"t": df}, {"p50": 0.5}).first()["p50"] == 1.5


@pytest.mark.parametrize(
    ("values", "kind", "role"),
    [
        (list(range(10)) * 10, "int", "dimension"),
        ([0.5 * v for v in range(10)] * 10, "double", "dimension"),
        ([0.5 * v for v in range(11)] * 10, "double", "measure"),
        ([float(v) for v in range(15)] * 10, "double", "dimension"),
        (list(range(30)) * 3, "int", "dimension"),
        ([2 * v for v in range(30)] * 3, "int", "measure"),
        (list(range(100)), "int", "measure"),
    ],
)
def test_numeric_role(spark, values, kind, role):
    df = spark.createDataFrame([(v,) for v in values], f"a {kind}")
    assert column_overview({"t": df}).first()["numeric_role"] == role


def test_top_values_break_ties_by_value(spark):
    words = [f"w{n:02d}" for n in range(12)]
    df = spark.createDataFrame([(w,) for w in words] + [("w11",)], "a string")
    got = [r["value"] for r in top_values({"t": df}).orderBy("rank").collect()]
    assert got == ["w11"] + words[:9]


def test_top_values_return_long_texts_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long,), (long,), ("short",)], "a string")
    rows = top_values({"t": df}).orderBy("rank").collect()
    assert [(r["value"], r["occurrences"]) for r in rows] == [(long, 2), ("short", 1)]


def test_booleans_have_top_values(spark):
    df = spark.createDataFrame([(True,), (True,), (False,), (None,)], "a boolean")
    rows = top_values({"t": df}).orderBy("rank").collect()
    assert [(r["value"], r["occurrences"]) for r in rows] == [("true", 2), ("false", 1)]


def test_decimals_are_numeric(spark):
    df = spark.createDataFrame([(Decimal("1.10"),), (Decimal("2.20"),)], "a decimal(10,2)")
    row = by_column(column_profile({"t": df}))["a"]
    assert (row["distinct_count"], round(row["p50"], 6)) == (2, 1.65)


def test_frequencies_count_times(spark):
    day = datetime(2024, 2, 29)
    df = spark.createDataFrame([(day,), (day,)], "t timestamp_ntz")
    assert frequencies(df).first()["n"] == 2


@pytest.mark.parametrize("bracket_rows", [10, 1_000_000])
@pytest.mark.parametrize("k", [50, 300, 16_384])
def test_quantiles_are_exact_with_narrow_brackets(spark, k, bracket_rows):
    """A coarse sketch takes the bracket path, few rows a bracket that of more scans."""
    rng = np.random.default_rng(7)
    skewed = np.concatenate([rng.exponential(100.0, 3000).round(2), np.full(2000, 7.0), [np.inf]])
    df = spark.createDataFrame([(float(v), None) for v in skewed], "a double, b int").repartition(5)
    wanted = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    row = column_quantiles({"t": df}, wanted, k=k, bracket_rows=bracket_rows, fan=2).collect()
    assert len(row) == 1
    expected = np.quantile(skewed, list(wanted.values()))
    assert np.allclose([row[0][x] for x in wanted][:-1], expected[:-1], rtol=0, atol=1e-9)
    assert row[0]["p100"] == np.inf


def test_narrowing_leaves_few_rows_in_a_bracket(spark):
    values = np.random.default_rng(3).permutation(60_000)
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    found = quantiles._brackets({"t": df}, [0.5, 0.9], 60_000, 2000, 1.0, 100, 64)
    spans = found["t", "a"]
    assert len(spans) == 2 and all(high - low <= 100 for low, high in spans)
    assert all(low <= 59_999 * p <= high for (low, high), p in zip(spans, [0.5, 0.9], strict=True))


def test_sketches_merge_in_levels(spark):
    df = spark.range(0, 40_000, 1, 16).select(F.col("id").cast("double").alias("a"))
    sketch = {"s": "a"}, {"n": "count(a)"}
    flat = sketches.merged(df, *sketch, rows=40_000, k=2000, levels=0)
    deep = sketches.merged(df, *sketch, rows=40_000, k=2000, fan=2, levels=4)
    # One exchange a level: 16 tasks meet in 8, 4, 2 groups and one, two at a time, then the root.
    assert deep._jdf.queryExecution().executedPlan().toString().count("Exchange") == 5
    for df in (flat, deep):
        r = df.select("n", F.expr(sketches.quantiles_sql("s", "n", [0.0, 0.25, 0.5, 1.0])).alias("q")).first()
        assert r["n"] == 40_000 and (r["q"][0], r["q"][3]) == (0, 39_999)
        assert abs(r["q"][1] - 10_000) <= 40_000 * 2 * sketches.rank_error(2000)
        assert abs(r["q"][2] - 20_000) <= 40_000 * 2 * sketches.rank_error(2000)
    assert [sketches.tree_levels(n) for n in (0, 100_000, 200_000, 64 * 10**5, 65 * 10**5, 10**12)] == [0, 0, 0, 0, 1, 3]


def test_approximate_quantiles_are_elements(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    row = column_quantiles({"t": df}, {"p50": 0.5}, exact=False).first()
    assert abs(row["p50"] - 499.5) <= 1
