"""What keeps the work per row small on large tables."""

import re

from pyspark.sql import functions as F

from tablescout.functions.local import work_folder
from tablescout.operators import correlate, profile, trends
from tablescout.operators.associate import associations
from tablescout.operators.frequency import frequencies
from tablescout.queries import trends as trend_queries


def _plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_statistics_of_wide_tables_run_as_generated_code(spark):
    wide = spark.range(3).select(*[(F.col("id") / (i + 2)).alias(f"c{i}") for i in range(24)])
    plan = _plan(spark, profile.column_stats({"t": wide}))
    lines = [line for line in plan.splitlines() if "HashAggregate(" in line]
    assert lines and all(re.search(r"\*\(\d+\) HashAggregate", line) for line in lines)
    assert profile.column_stats({"t": wide}).count() == 24


def test_fractions_of_large_and_infinite_values(spark):
    values = [0.5, -0.5, 0.0, -0.0, 2.0, 1e300, 2.0**52 + 1, 2.0**51 + 0.5, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    expected = df.where("v % 1 <> 0 AND NOT isnan(v)").count()
    assert profile.column_stats({"t": df}).first()["fraction_count"] == expected


def test_numbers_are_grouped_without_room_for_texts(spark):
    rows = spark.createDataFrame([(1, "x", 0.5, "1969-12-31 23:59:59.5")], "a bigint, b string, c double, d string")
    df = rows.withColumn("d", F.col("d").cast("timestamp_ntz"))
    dealt = re.findall(r"hashpartitioning\(ordinal#\d+, (\w+)#\d+L?, \d+\)", _plan(spark, frequencies(df)))
    assert sorted(dealt) == ["float_key", "int_key", "text_key", "time_key"]
    found = {r["column_name"]: (r["int_key"], r["float_key"], r["text_key"], r["n"]) for r in frequencies(df).collect()}
    assert found == {
        "a": (1, None, None, 1), "b": (None, None, "x", 1), "c": (None, 0.5, None, 1), "d": (-500000, None, None, 1),
    }


def test_the_panel_looks_at_its_tables_once(spark, monkeypatch):
    calls = []

    def counted(tables):
        calls.append(sorted(tables))
        return profile.column_overview(tables)

    monkeypatch.setattr(trends, "column_overview", counted)
    monkeypatch.setattr(trend_queries, "column_overview", counted)
    trend_queries.QUERIES["trend_panel"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_pairs_of_columns_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(rows):
        for row in rows:
            seen.add(1)
            yield row

    texts = spark.range(40).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    df = spark.createDataFrame(texts.rdd.mapPartitions(look), texts.schema)
    assert associations(df).count() == 1
    assert seen.value == 40


def test_ranks_take_two_shuffles_and_no_join(spark):
    df = spark.range(70_000).coalesce(1).select(
        (F.col("id") * 7919 % 1000).cast("double").alias("a"),
        F.when(F.col("id") % 3 != 0, F.col("id") * 48271 % 65537 / 8 - 100).alias("b"),
        F.when(F.col("id") % 100 == 0, float("inf")).otherwise(F.col("id") % 2).alias("c"),
    )
    lists = [("a", "true"), ("b", "true"), ("a", "b IS NOT NULL"), ("c", "true")]
    hot = [[3.0, 500.0], [0.0, 17.25], [3.0, 500.0], [0.0, 1.0]]
    found = correlate.ranks(df, lists, hot, work_folder(spark))
    plan = _plan(spark, found)
    assert plan.count("Exchange") == 2 and "Join" not in plan and "Window" not in plan
    got = found.orderBy("_row").toPandas()
    given = df.toPandas()
    given["a_b"] = given["a"].where(given["b"].notna())
    for i, c in enumerate(["a", "b", "a_b", "c"]):
        assert got[f"r{i}"].equals(given[c].rank()), c
