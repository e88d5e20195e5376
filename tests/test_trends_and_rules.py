"""Trends, KPIs, insights, tasks, sampling, sinks and the whole exploration."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablescout.operators import insights as n
from tablescout.operators import kpi as k
from tablescout.operators import sampling as s
from tablescout.operators import shape
from tablescout.operators import trends as t
from tablescout.operators.profile import column_overview, column_stats
from tablescout.plans import explore, explore_sources, write_exploration
from tablescout.sources import head_sample, read_csv, read_findings, write_findings


def series(spark, *points):
    return spark.createDataFrame(list(points), "at timestamp_ntz, v double")


def test_week_is_monday_to_sunday(spark):
    df = series(
        spark,
        (datetime(2024, 1, 7, 15), 1.0),
        (datetime(2024, 1, 8), 2.0),
        (datetime(2024, 1, 14, 23, 59), 4.0),
    )
    got = {x["period"]: x["value"] for x in t.trend(df, "at", "v", "sum", "week").collect()}
    assert got == {datetime(2024, 1, 1): 1.0, datetime(2024, 1, 8): 6.0}
    ends = df.limit(1).select(
        *[
            t.period_end(F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz"), g).alias(g)
            for g in ("month", "year", "day")
        ]
    ).first()
    assert (ends["month"], ends["year"]) == (datetime(2024, 2, 29), datetime(2024, 12, 31))
    assert ends["day"] == datetime(2024, 2, 1)


@pytest.mark.parametrize(
    ("how", "gap"), [("sum", 0.0), ("count", 0), ("avg", None), ("min", None), ("max", None)]
)
def test_gap_fill(spark, how, gap):
    df = series(spark, (datetime(2024, 1, 1), 1.0), (datetime(2024, 1, 3), 3.0), (None, 9.0))
    plain = t.trend(df, "at", "v", how, "day")
    filled = {x["period"].day: x["value"] for x in t.trend(df, "at", "v", how, "day", True).collect()}
    assert list(sorted(filled)) == [1, 2, 3]
    assert filled[2] == gap
    if how == "sum":
        assert sum(filled.values()) == sum(x["value"] for x in plain.collect()) == 4.0


def test_missing_metric_drops_the_row_but_not_for_distinct(spark):
    df = series(spark, (datetime(2024, 1, 1), None), (datetime(2024, 1, 2), 5.0))
    assert t.trend(df, "at", "v", "count").count() == 1
    got = {x["period"].day: x["value"] for x in t.trend(df, "at", "v", "count_distinct").collect()}
    assert got == {1: 0, 2: 1}


def test_unknown_names_fall_back(spark):
    df = series(spark, (datetime(2024, 1, 1, 5), 1.0), (datetime(2024, 1, 1, 9), 2.0))
    row = t.trend(df, "at", "v", "median", "decade").first()
    assert (row["period"], row["value"]) == (datetime(2024, 1, 1), 3.0)


def test_text_and_boolean_metrics(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "1.5", True), ("2024-01-01", "bad", None), ("no time", "2", True)],
        "at string, m string, b boolean",
    )
    assert t.trend(df, "at", "m").first()["value"] == 1.5
    assert t.trend(df, "at", "b").first()["value"] == 1.0
    assert t.trend(df, "at", "b", "count").first()["value"] == 2
    assert t.primary_time_columns({"t": df}).first()["time_column"] == "at"


def test_times_cannot_be_metrics(spark):
    df = series(spark, (datetime(2024, 1, 1), 1.0)).withColumn("other", F.col("at"))
    for how in ("sum", "count_distinct"):
        with pytest.raises(ValueError):
            t.trend(df, "at", "other", how)


@pytest.mark.parametrize(
    ("points", "hours", "expected"),
    [
        (1, 0, "day"), (11, 2, "hour"), (10, 2, "day"), (20, 24, "day"), (50, 60, "week"),
        (4, 24, "day"), (40, 24, "day"), (3, 24 * 20, "week"), (100, 24 * 3, "week"),
        (5, 24 * 60, "month"), (13, 24 * 100, "year"),
    ],
)
def test_granularity(spark, points, hours, expected):
    start = datetime(2020, 1, 1)
    df = series(spark, *[(start + timedelta(hours=hours * p), 1.0) for p in range(points)])
    got = t.optimal_granularity({"t": df}, [("t", "at")]).first()["granularity"]
    assert got == expected


def test_trailing_years_from_a_leap_day(spark):
    df = series(
        spark,
        (datetime(2024, 2, 29, 10), 1.0),
        (datetime(2022, 2, 28, 10), 2.0),
        (datetime(2022, 2, 28, 9), 4.0),
    )
    assert t.trailing_years(df, "at").agg(F.sum("v")).first()[0] == 3.0


def test_categories_need_2_to_100_values(spark):
    many = spark.range(101).select(F.col("id").cast("string").alias("c"))
    assert t.ranked_categories(many, "c").count() == 0
    assert t.ranked_categories(many.where("c = '1'"), "c").count() == 0
    assert t.ranked_categories(many.where("id < 100"), "c").count() == 10


def test_categorical_trend_shows_zeroes(spark):
    day = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(day, "a"), (day + timedelta(days=2), "b"), (day, "a")], "at timestamp_ntz, c string"
    )
    got = {
        (x["value"], x["period"].day): x["occurrences"]
        for x in t.categorical_trend(df, "at", "c", "day").collect()
    }
    assert got == {("a", 1): 2, ("a", 2): 0, ("a", 3): 0, ("b", 1): 0, ("b", 2): 0, ("b", 3): 1}


def sales(spark):
    start = datetime(2024, 1, 1)
    rows = [
        (i, start + timedelta(days=i % 30), float(i % 50), i % 2, i % 3 == 0, f"note {i}", start)
        for i in range(300)
    ]
    return spark.createDataFrame(
        rows, "sale_id int, at timestamp_ntz, amount double, flag int, vip boolean, note string,"
        "loaded timestamp_ntz",
    )


def test_trend_batch_chooses_and_explains(spark):
    tables = {"sales": sales(spark), "plain": spark.createDataFrame([(1,)], "x int")}
    wanted = [("sales", c) for c in ("sale_id", "amount", "flag", "vip", "note")] + [
        ("plain", "x"), ("sales", "none"), ("other", "x"), ("", "x"),
    ]
    trends, failures = t.trend_batch(spark, tables, wanted)
    how = {x["column_name"]: (x["aggregation"], x["granularity"]) for x in trends.collect()}
    assert how == {
        "sale_id": ("count_distinct", "day"), "amount": ("sum", "day"), "flag": ("sum", "day"),
        "vip": ("sum", "day"),
    }
    reasons = {(x["table_name"], x["column_name"]): x["reason_code"] for x in failures.collect()}
    assert reasons == {
        ("sales", "note"): "no_kpi_and_not_numeric", ("plain", "x"): "no_time_column",
        ("sales", "none"): "column_missing", ("other", "x"): "table_missing",
        ("", "x"): "no_table_prefix",
    }
    total = trends.where("column_name = 'amount'").agg(F.sum("value")).first()[0]
    assert total == sales(spark).agg(F.sum("amount")).first()[0]
    panel = t.trend_panel(trends, column_overview(tables))
    assert panel.where("column_name = 'amount' AND series = 'dimension sum by day'").count() == 30


def test_kpi_rules(spark):
    df = spark.createDataFrame(
        [(1, 0.1, -5, True, "a"), (2, 0.9, 7, False, "b")],
        "user_id int, share double, delta int, ok boolean, kind string",
    )
    stats = column_stats({"t": df})
    numeric = {(x["kpi_column"], x["kpi_type"]): x["relevance"] for x in k.numeric_kpis(stats).collect()}
    assert numeric == {
        ("user_id", "count_distinct"): 0.9, ("share", "sum"): 0.8, ("share", "average"): 0.7,
        ("share", "count"): 0.6, ("share", "percentage"): 0.9, ("delta", "average"): 0.7,
    }
    assert [x["kpi_column"] for x in k.boolean_kpis(stats).collect()] == ["ok"]
    assert {tuple(x["columns"]) for x in k.ratio_kpis(stats).collect()} == {("user_id", "share")}
    assert {tuple(x["columns"]) for x in k.percentage_kpis(stats).collect()} == {
        ("user_id", "delta"), ("share", "delta"),
    }
    assert k.trend_kpis(stats).count() == 0
    kpis = k.kpi_suggestions({"t": df})
    assert kpis.where("kpi_type = 'count' AND value = 'a'").first()["occurrences"] == 1
    values = {
        x["formula"]: x["result"]
        for x in k.evaluate_kpis({"t": df}, kpis, column_overview({"t": df})).collect()
    }
    assert values["COUNT(DISTINCT user_id)"] == 2
    assert values["SUM(ok)"] == 1
    assert values["user_id / share"] == pytest.approx(3.0)
    assert values["COUNT(kind = 'a')"] == 1


def test_insights_and_tasks(spark):
    rows = [(i, 2.0 * i, None if i % 2 else "x", "t") for i in range(20)]
    df = spark.createDataFrame(rows, "a int, b double, event_type string, kind string")
    from tablescout.operators.correlate import pearson
    from tablescout.operators.validate import validation_report

    found = n.missingness_insights(column_stats({"t": df})).unionByName(
        n.correlation_insights(pearson({"t": df}))
    )
    ranked = [(x["rank"], x["insight_id"], x["score"], x["severity"]) for x in n.rank_insights(found).orderBy("rank").collect()]
    assert ranked == [
        (1, "corr_t.a_t.b", 100.0, "high"), (2, "high_null_t.event_type", 50.0, "high"),
    ]
    tasks = n.organize_tasks(found, None, validation_report({"t": df}), None)
    got = {x["task_id"]: (x["category"], x["priority"], len(x["actions"])) for x in tasks.collect()}
    # A column called event_type does not turn a correlation or a task into a type problem.
    assert got["corr_t.a_t.b"] == ("relationships", "critical", 2)
    assert got["high_null_t.event_type"] == ("data_quality", "high", 2)
    summary = {(x["category"], x["priority"]): x["tasks"] for x in n.task_summary(tasks).collect()}
    assert summary[(None, None)] == len(got)
    weighted = n.rank_insights_weighted(found, full_at=40).orderBy("rank").first()
    assert (weighted["confidence"], weighted["weighted_score"]) == (0.5, 50.0)


def test_sampling_is_repeatable_and_keeps_extremes(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 97).alias("v")).repartition(7)
    first = {x["id"] for x in s.random_sample(df, "id", 500).collect()}
    again = {x["id"] for x in s.random_sample(df.coalesce(2), "id", 500).collect()}
    assert first == again and 400 <= len(first) <= 500
    multi = s.multistage_sample(df, "id", 1000, 0.1)
    assert multi.count() <= 1000
    assert multi.dropDuplicates().count() == multi.count()
    edge = s.corner_cases(df, df, "id", 25)
    assert edge.where("id < 200 OR id >= 19800").count() >= 25
    per = s.stratified_sample(df, "v", "id", 3).groupBy("v").count()
    assert {x["count"] for x in per.collect()} == {3}
    assert s.sample_percent(10, 100) == 100.0 and s.sample_percent(10**9, 10) == 0.1
    assert s.proportional_sample(df, "v", {0: 1.0}).count() == df.where("v = 0").count()


def test_sample_quality_of_the_whole_is_perfect(spark):
    df = spark.createDataFrame([(i, f"w{i % 4}") for i in range(100)], "a int, b string")
    rows = {x["column_name"]: x for x in s.sample_quality(df, df).collect()}
    assert (rows["a"]["mean_error"], rows["a"]["std_error"]) == (0.0, 0.0)
    assert (rows["b"]["top_value_overlap"], rows["b"]["coverage_ratio"]) == (1.0, 1.0)


def test_masking_covers_the_whole_text(spark):
    text = "word " * 5000 + "mail me@example.com or 10.0.0.1"
    df = spark.createDataFrame([(1, text)], "id int, body string")
    row = shape.masked(df, ["body"], ["id"]).first()
    assert row["body"].endswith("mail *** or ***")
    assert len(row["id"]) == 64


def test_csv_and_sinks(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("order_id,order_date,amount\n1,2024-01-03,5.5\n2,2024-01-04,\n\n\n")
    df = read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "date", "double"]
    assert df.count() == 2
    assert head_sample(df, 1, ["order_id"]).first()["amount"] == 5.5
    findings = {"stats": column_stats({"orders": df})}
    for fmt in ("parquet", "json"):
        write_findings(findings, str(tmp_path / fmt), fmt)
        assert read_findings(spark, str(tmp_path / fmt), ["stats"], fmt)["stats"].count() == 3


def test_exploration_end_to_end(spark, tmp_path):
    people = spark.createDataFrame([(i, f"p{i % 5}") for i in range(40)], "person_id int, team string")
    findings = explore(spark, {"people": people, "sales": sales(spark)})
    write_exploration(findings, str(tmp_path / "out"))
    back = read_findings(spark, str(tmp_path / "out"), ["relationship", "task", "trend"])
    assert back["relationship"].where("source_column = 'person_id' AND target_column = 'sale_id'").count() == 1
    assert back["task"].count() == findings["task"].count() > 0
    both = explore_sources(spark, {"hr": {"people": people}, "shop": {"sales": sales(spark)}}, 3)
    assert both["relationship"].where("cross_source").count() > 0
    assert both["overview"].first()["total_tables"] == 2
