"""Profiles from stored states of files."""

import pytest
from pyspark.sql import functions as F

from tablescout.operators.incremental import file_states, files_of, incremental_profile, stored_states
from tablescout.operators.sketches import rank_error

SCHEMA = "a int, b double, c string, t timestamp_ntz, e array<int>"


def part(spark, folder, name, low, high):
    df = spark.range(low, high).select(
        F.when(F.col("id") % 5 != 0, F.col("id")).cast("int").alias("a"),
        F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(1e9 + F.col("id")).alias("b"),
        F.concat(F.lit("t"), F.col("id") % 50).alias("c"),
        F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("t"),
        F.array(F.col("id").cast("int")).alias("e"),
    )
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def expected(df):
    df = df.withColumn("b", F.nanvl("b", F.lit(None).cast("double")))
    return df.agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in "ab" for f in (F.count, F.min, F.max, F.avg, F.stddev)],
    ).first()


@pytest.mark.parametrize("fan", [2, 64])
def test_only_changed_files_are_read(spark, tmp_path, fan):
    folder, store = f"{tmp_path}/table with blank", f"{tmp_path}/store"
    for k in range(5):
        part(spark, folder, f"p{k}", k * 1000, (k + 1) * 1000)
    first = {r["column_name"]: r for r in incremental_profile(spark, folder, store, fan=fan).collect()}
    assert {r["scanned_rows"] for r in first.values()} == {5000}
    again = incremental_profile(spark, folder, store, fan=fan).collect()
    assert {r["scanned_rows"] for r in again} == {0} and {r["row_count"] for r in again} == {5000}

    part(spark, folder, "p1", 10_000, 10_300)  # replaced
    part(spark, folder, "p7", 50_000, 50_500)  # added
    before = {r["file"] for r in stored_states(spark, store).select("file").distinct().collect()}
    now = {r["column_name"]: r for r in incremental_profile(spark, folder, store, fan=fan).collect()}
    after = {r["file"] for r in stored_states(spark, store).select("file").distinct().collect()}
    assert len(after - before) == 2 and files_of(spark, folder).where("length > 0").count() >= 6
    assert {r["scanned_rows"] for r in now.values()} == {800}
    whole = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    e = expected(whole)
    for c in "ab":
        assert now[c]["row_count"] == e["n"] == 4800
        assert now[c]["null_count"] == e["n"] - e[f"count_{c}"]
        assert (now[c]["min"], now[c]["max"]) == (e[f"min_{c}"], e[f"max_{c}"])
        assert now[c]["mean"] == pytest.approx(e[f"avg_{c}"], rel=1e-12)
        assert now[c]["std"] == pytest.approx(e[f"stddev_{c}"], rel=1e-9)
    below = whole.where(f"b <= {now['b']['p50']!r}").count() / whole.where("not isnan(b)").count()
    assert abs(below - 0.5) <= 2 * rank_error() + 1e-3
    assert abs(now["c"]["approx_distinct"] - 50) <= 3
    assert (now["t"]["min_time"], now["t"]["max"]) == ("1970-01-01 00:00:00", None)
    assert now["e"]["null_count"] == 0 and now["e"]["approx_distinct"] is None or now["e"]["approx_distinct"] == 0


def test_a_table_without_rows(spark, tmp_path):
    folder = f"{tmp_path}/t"
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    rows = incremental_profile(spark, folder, f"{tmp_path}/s").collect()
    assert all(r["row_count"] in (0, None) for r in rows)


def test_states_of_another_form_are_scanned_again(spark, tmp_path):
    folder, store = f"{tmp_path}/table", f"{tmp_path}/store"
    part(spark, folder, "p0", 0, 1000)
    incremental_profile(spark, folder, store).collect()
    spark.read.parquet(store).drop("form").write.parquet(f"{tmp_path}/older")
    rows = incremental_profile(spark, folder, f"{tmp_path}/older").collect()
    assert {(r["row_count"], r["scanned_rows"]) for r in rows} == {(1000, 1000)}


def test_a_scan_aggregates_a_number_by_three_moments_and_two_sketches(spark, tmp_path):
    """Counts and extremes come from the sketch, and what sketches read is projected first."""
    folder = f"{tmp_path}/t"
    rows = [(float("inf"), 1), (float("nan"), 2), (-0.0, 3), (None, None), (2.5, 7), (-8.25, 2**53)]
    spark.createDataFrame(rows, "b double, a bigint").coalesce(1).write.parquet(folder)
    states = file_states(spark.read.parquet(folder), "r")
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "Aggregate [" in x)
    assert "min(" not in line and "max(" not in line and "xxhash64" not in line and "cast" not in line
    got = {r["ordinal"]: (r["rows"], r["present"], r["min"], r["max"]) for r in states.collect()}
    assert got == {0: (6, 4, -8.25, float("inf")), 1: (6, 5, 1.0, 2.0**53)}
