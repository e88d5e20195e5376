"""Associations of mixed columns, drift between windows, allocated samples."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescout.operators import cells, sampling
from tablescout.operators.frequency import distinct_up_to
from tablescout.operators.trends import category_failures


def _information(pairs):
    n, ab = len(pairs), Counter(pairs)
    a, b = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    return sum(c / n * math.log(c * n / (a[x] * b[y])) for (x, y), c in ab.items())


def test_mixed_associations(spark):
    rows = [(k, float(k % 7), "ab"[k % 2], f"free text {k}", k % 3 == 0) for k in range(1000)]
    rows += [(None, math.nan, None, None, None)] * 5
    df = spark.createDataFrame(rows, "n int, v double, kind string, note string, flag boolean")
    found = {(r.col_a, r.col_b): r for r in cells.mixed_associations({"t": df}).collect()}
    names = {x for pair in found for x in pair}
    assert names == {"n", "v", "kind", "flag"}  # the free text is left out
    edges = cells.cell_edges({"t": df})
    assert edges["t", "n"][0] == 99.9 and len(edges["t", "n"]) == 9

    def code(k, c):
        if c == "kind":
            return "ab"[k % 2]
        if c == "flag":
            return k % 3 == 0
        value = k if c == "n" else k % 7
        return sum(value >= e for e in edges["t", c])

    for (a, b), r in found.items():
        assert r.n == 1000
        expected = _information([(code(k, a), code(k, b)) for k in range(1000)])
        assert r.mutual_information == pytest.approx(max(expected, 0), abs=1e-9)


def test_mixed_associations_without_columns(spark):
    empty = spark.createDataFrame([], "n int, v double, kind string")
    assert cells.mixed_associations({"t": empty}).count() == 0
    one = spark.createDataFrame([(1, "x")], "n int, note string")
    assert cells.mixed_associations({"t": one}).count() == 0


def test_hot_value_leaves_fewer_edges(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 950, 0).otherwise(F.col("id")).alias("v"))
    assert cells.cell_edges({"t": df}) == {("t", "v"): [0.0]}


def test_windows(spark):
    # The mix of kinds turns on day 20; v stays alike.
    rows = [(f"2024-01-{d:02d}", "x" if (d < 20) == (k % 10 > 0) else "y", k) for d in range(1, 31) for k in range(50)]
    df = spark.createDataFrame(rows, "d string, kind string, v int").withColumn("ts", F.to_timestamp_ntz("d"))
    df = df.unionByName(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))).drop("d")
    counts = cells.period_counts(df, "ts", "day").cache()
    assert counts.where("column_name = 'kind'").agg(F.sum("n")).first()[0] == 1500
    drift = {
        r.column_name: r
        for r in cells.window_drift(counts, ("2024-01-05", "2024-01-15"), ("2024-01-22", "2024-01-24")).collect()
    }
    assert (drift["kind"].n_first, drift["kind"].n_second) == (500, 100)
    assert drift["kind"].total_variation == pytest.approx(0.8)
    assert drift["v"].total_variation == pytest.approx(0)
    outside = cells.window_drift(counts, ("2023-01-01", "2023-02-01"), ("2024-01-01", "2024-02-01")).collect()
    assert all(r.n_first == 0 and r.total_variation is None for r in outside)
    change = {r.column_name: r for r in cells.largest_change(counts, 5).collect()}
    assert str(change["kind"].change_period)[:10] == "2024-01-20"
    assert change["kind"].change == pytest.approx(0.8)
    assert str(change["v"].change_period)[:10] == "2024-01-06"  # no change: the earliest
    assert cells.largest_change(counts, 16).count() == 0
    assert cells.period_counts(df.limit(0), "ts", "day").count() == 0


def test_allocation():
    assert sampling._allocation([(900, 900), (100, 100)], 100) == [90, 10]
    assert sampling._allocation([(3, 3), (3, 3), (3, 3)], 4) == [2, 1, 1]
    assert sampling._allocation([(1000, 1000), (1, 1)], 10) == [9, 1]  # at least one
    assert sampling._allocation([(5, 1000.0), (100, 1.0)], 50) == [5, 45]  # no more than there are
    assert sampling._allocation([(5, 0.0), (7, 0.0)], 12) == [5, 7]
    assert sampling._allocation([(2, 10.0), (5, 0.0)], 2) == [1, 1]
    for size in range(4, 120):
        held = [(50, 2.0), (1, 9.0), (60, 30.0), (9, 0.0)]
        drawn = sampling._allocation(held, size)
        assert sum(drawn) == size and all(1 <= d <= n for d, (n, _) in zip(drawn, held))


def test_allocated_sample(spark):
    # One stratum holds most rows, one is NULL; half of all rows share one key.
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("key"),
        F.when(F.col("id") < 2500, "big").when(F.col("id") < 2990, "mid").alias("kind"),
        (F.col("id") % 10).alias("v"),
        F.col("id").alias("Weight"),
    )
    for measure in (None, "v"):
        drawn = sampling.allocated_sample(df, "kind", "key", 300, measure).collect()
        assert len(drawn) == 300
        assert {r.kind for r in drawn} == {"big", "mid", None}
        assert sum(r.weight for r in drawn) == pytest.approx(3000)
    assert sampling.allocated_sample(df, "kind", "key", 5000).count() == 3000
    assert sampling.allocated_sample(df.limit(0), "kind", "key", 10).count() == 0
    with pytest.raises(ValueError):
        sampling.allocated_sample(df, "kind", "key", 2)
    again = [sorted(map(str, sampling.allocated_sample(df.repartition(n), "kind", "key", 300).collect())) for n in (2, 5)]
    assert again[0] == again[1]


def test_distinct_up_to(spark):
    df = spark.range(500).select(
        F.concat(F.lit("free "), "id").alias("free"), (F.col("id") % 101).cast("string").alias("over"),
        (F.col("id") % 100).cast("string").alias("full"), F.lit(None).cast("string").alias("none"),
        F.lit("x").alias("one"),
    )
    assert distinct_up_to(df, df.columns, 100) == {"free": None, "over": None, "full": 100, "none": 0, "one": 1}
    failed = category_failures({"t": df}, [("t", c) for c in df.columns]).collect()
    assert {(r.column_name, r.reason_code) for r in failed} == {
        ("free", "too_many_values"), ("over", "too_many_values"), ("none", "too_few_values"), ("one", "too_few_values"),
    }
