"""Set sketches of columns and their overlaps."""

import pytest
from pyspark.sql import functions as F

from tablescout.operators.setsketch import approx_overlaps, column_sketches


def overlaps(spark, tmp_path, bits=12, **how):
    first = spark.range(20_000).select(
        F.col("id").cast("int").alias("k"),
        (F.col("id") % 100).cast("double").alias("small"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 2).alias("half"),
        F.concat(F.lit("t"), F.col("id") % 3000).alias("t"),
        F.lit(None).cast("string").alias("nothing"),
    )
    second = spark.range(5_000, 60_000).select(
        F.col("id").alias("k"), F.col("id").cast("decimal(12,2)").alias("d"),
        F.concat(F.lit("t"), F.col("id") % 9000).alias("t"), F.array("id").alias("list"),
    )
    stored = f"{tmp_path}/sketches"
    for name, df in (("a.b", first), ("c'd", second)):
        column_sketches({name: df.repartition(20)}, bits, **how).write.mode("append").parquet(stored)
    kept = spark.read.parquet(stored)
    found = approx_overlaps(kept.where("table_name = 'a.b'"), kept.where("table_name <> 'a.b'"), bits)
    return {(r["source_column"], r["target_column"]): r for r in found.collect()}


EXACT = {
    ("k", "k"): 15_000, ("k", "d"): 15_000, ("small", "k"): 0, ("small", "d"): 0, ("half", "k"): 0,
    ("half", "d"): 0, ("t", "t"): 3000, ("nothing", "t"): 0,
}


@pytest.mark.parametrize("how", [{}, {"levels": 3, "fan": 2}, {"bits": 10}])
def test_estimates_are_within_their_bound(spark, tmp_path, how):
    found = overlaps(spark, tmp_path, **how)
    assert set(found) == set(EXACT)
    for pair, row in found.items():
        assert abs(row["overlap_count"] - EXACT[pair]) <= row["overlap_error"], pair
        assert 0 <= row["match_rate"] <= 1
    assert found["nothing", "t"]["source_unique"] == 0
    assert found["small", "k"]["source_unique"] == 100
    assert 0 < found["k", "k"]["overlap_error"] < 5000


def test_few_values_are_exact(spark):
    one = spark.createDataFrame([(1, "x", True), (2, None, False), (3, "z", None)], "n int, s string, b boolean")
    two = spark.createDataFrame([(2.0, "z"), (3.5, "x"), (None, "x")], "f double, s string")
    found = approx_overlaps(column_sketches({"one": one}), column_sketches({"two": two})).collect()
    got = {(r["source_column"], r["target_column"]): (r["overlap_count"], r["overlap_error"]) for r in found}
    assert got == {("n", "f"): (1, 0), ("s", "s"): (2, 0)}
    assert [r["match_rate"] for r in found if r["source_column"] == "n"] == [pytest.approx(1 / 3)]


def test_tables_without_columns_or_rows(spark):
    assert column_sketches({"a": spark.range(3).select(F.array("id").alias("l"))}).count() == 0
    empty = column_sketches({"e": spark.createDataFrame([], "a int, b string")})
    full = column_sketches({"f": spark.createDataFrame([(1, "x")], "a int, b string")})
    rows = approx_overlaps(empty, full).collect()
    assert len(rows) in (0, 2) and all(r["overlap_count"] == 0 for r in rows)
