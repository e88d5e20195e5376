"""Metrics over time: calendar periods, gap filling, automatic granularity, batch trends.

Periods are named by their start (Monday for weeks) for every aggregation; ``period_end``
gives the other label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.local import pin
from tablescout.functions.sqltext import local_frame
from tablescout.functions.text import key_like
from tablescout.functions.types import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXT,
    col,
    family,
    names_of,
    nan_to_null,
    union_all,
)
from tablescout.operators.frequency import distinct_up_to
from tablescout.operators.kpi import best_kpis, kpi_suggestions
from tablescout.operators.profile import column_overview

GRANULARITIES = ["hour", "day", "week", "month", "year"]
AGGREGATIONS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}
TOP_N = 5
CATEGORY_LIMIT = 100

# The aggregation that draws each kind of KPI.
AGGREGATION_OF_KPI = {
    "sum": "sum",
    "average": "avg",
    "count": "count",
    "trend": "sum",
    "ratio": "avg",
    "percentage": "avg",
}


def as_time(df: DataFrame, name: str) -> Column:
    """The column as a zone-free timestamp; text that does not parse is missing."""
    if family(df.schema[name].dataType) == TEXT:
        return col(name).try_cast("timestamp_ntz")
    return col(name).cast("timestamp_ntz")


def as_metric(df: DataFrame, name: str) -> Column:
    """The column as a double: bad text is missing, booleans are 0/1 with missing as 0."""
    kind = family(df.schema[name].dataType)
    if kind == BOOLEAN:
        return F.coalesce(col(name).cast("int"), F.lit(0)).cast("double")
    if kind == TEXT:
        return col(name).try_cast("double")
    if kind == DATETIME:
        raise ValueError(f"{name} is a time and cannot be aggregated as a metric")
    return col(name).cast("double")


def period_of(time: Column, granularity: str) -> Column:
    """Start of the period of a zone-free time, without passing through the session's zone."""
    day = time.cast("date")
    if granularity == "hour":
        return F.make_timestamp_ntz(
            F.year(time), F.month(time), F.day(time), F.hour(time), F.lit(0), F.lit(0)
        )
    if granularity in ("week", "month", "year"):
        day = F.trunc(day, granularity)
    return day.cast("timestamp_ntz")


def period_end(period: Column, granularity: str) -> Column:
    """Last day of a period that starts at ``period``; hours and days keep their start."""
    if granularity == "week":
        return F.date_add(period.cast("date"), 6).cast("timestamp_ntz")
    if granularity == "month":
        return F.last_day(period.cast("date")).cast("timestamp_ntz")
    if granularity == "year":
        return F.make_date(F.year(period), F.lit(12), F.lit(31)).cast("timestamp_ntz")
    return period


def time_columns(schema: DataFrame) -> DataFrame:
    """All columns declared as dates or timestamps."""
    return schema.where(F.col("family") == DATETIME).select("table_name", "column_name", "ordinal")


def primary_time_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """First column of each table that is a time, or a text with at least one readable time."""
    parts = []
    for table, df in tables.items():
        names = names_of(df, DATETIME, TEXT)
        declared = names_of(df, DATETIME)
        # Text columns behind the first declared time cannot win, so they are not parsed.
        if declared:
            names = names[: names.index(declared[0]) + 1]
        if not names:
            continue
        checks = [
            F.lit(True)
            if c in declared
            else F.coalesce(F.bool_or(col(c).try_cast("timestamp_ntz").isNotNull()), F.lit(False))
            for c in names
        ]
        wide = df.agg(
            F.count(F.lit(1)).alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(checks)]
        )
        first = F.coalesce(*[F.when(F.col(f"c{i}"), F.lit(c)) for i, c in enumerate(names)])
        parts.append(
            wide.select(F.lit(table).alias("table_name"), first.alias("time_column")).where(
                "time_column IS NOT NULL"
            )
        )
    return union_all(parts, tables, "table_name string, time_column string")


def granularity_rule() -> Column:
    """Granularity from ``first``, ``last`` (timestamps) and ``points``."""
    seconds = F.timestamp_diff("SECOND", F.col("first"), F.col("last"))
    days = F.floor(seconds / 86400)
    density = F.col("points") / F.greatest(days, F.lit(1))
    return (
        F.when(F.col("points") < 2, "day")
        .when((seconds < 86400) & (F.col("points") > 10), "hour")
        .when(days < 7, "day")
        .when(days < 90, F.when(density < 0.5, "week").otherwise("day"))
        .when(days < 365, F.when(density < 0.1, "month").otherwise("week"))
        .when(days < 365 * 3, "month")
        .otherwise("year")
    )


def optimal_granularity(tables: dict[str, DataFrame], times: list[tuple[str, str]]) -> DataFrame:
    """Granularity of each ``(table, time column)`` from its span and density."""
    parts = []
    for table, name in times:
        t = as_time(tables[table], name)
        span = tables[table].agg(
            F.min(t).alias("first"), F.max(t).alias("last"), F.count(t).alias("points")
        )
        parts.append(
            span.select(
                F.lit(table).alias("table_name"),
                F.lit(name).alias("time_column"),
                "points",
                granularity_rule().alias("granularity"),
            )
        )
    return union_all(parts)


def trend(
    df: DataFrame,
    time: str,
    metric: str,
    aggregation: str = "sum",
    granularity: str = "day",
    fill_gaps: bool = False,
) -> DataFrame:
    """``(period, value)``: one aggregate per calendar period.

    Rows without a time or metric do not count. ``count_distinct`` accepts any metric type and
    is never gap-filled. An unknown aggregation sums and an unknown granularity is a day.
    """
    # The test for a missing time is pushed into the scan where the time is declared as one.
    clean = nan_to_null(df).where(as_time(df, time).isNotNull())
    period = period_of(as_time(clean, time), granularity).alias("period")
    if aggregation == "count_distinct":
        if family(clean.schema[metric].dataType) == DATETIME:
            raise ValueError(f"{metric} is a time and cannot be counted as a metric")
        # Distinct pairs first: a period that holds most rows is spread over its values.
        pairs = clean.select(period, col(metric).alias("value")).distinct()
        return pairs.groupBy("period").agg(F.count("value").alias("value"))
    value = as_metric(clean, metric).alias("value")
    aggregate = AGGREGATIONS.get(aggregation, F.sum)
    points = (
        clean.select(period, value)
        .where("value IS NOT NULL")
        .groupBy("period")
        .agg(aggregate("value").alias("value"))
    )
    return fill(points, aggregation, granularity) if fill_gaps else points


def _steps(first: Column, last: Column, granularity: str) -> Column:
    unit = granularity if granularity in GRANULARITIES else "day"
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    return F.sequence(first, last, step)


def fill(points: DataFrame, aggregation: str, granularity: str, *keys: str) -> DataFrame:
    """Add the empty periods between each series' own first and last period.

    ``points`` has one row per series and period, so the grid is as long as the calendar.
    """
    span = points.groupBy(*keys).agg(F.min("period").alias("first"), F.max("period").alias("last"))
    grid = span.where("first IS NOT NULL").select(
        *keys, F.explode(_steps(F.col("first"), F.col("last"), granularity)).alias("period")
    )
    filled = grid.join(points, [*keys, "period"], "left")
    if aggregation in ("avg", "min", "max"):
        return filled
    kind = points.schema["value"].dataType
    return filled.withColumn("value", F.coalesce("value", F.lit(0).cast(kind)))


def trailing_years(df: DataFrame, time: str, years: int = 2) -> DataFrame:
    """Rows from ``years`` before the latest time on; 29 February goes back to the 28th."""
    t = as_time(df, time)
    since = df.agg((F.max(t) - F.make_ym_interval(F.lit(years))).alias("since")).scalar()
    return df.where(t >= since)


def category_failures(
    tables: dict[str, DataFrame], columns: list[tuple[str, str]], most_values: int = CATEGORY_LIMIT
) -> DataFrame:
    """``(table_name, column_name, reason_code)`` of the columns that have no categorical trend."""
    failed = []
    for table, df in tables.items():
        asked = [c for t, c in columns if t == table]
        for column, n in distinct_up_to(df, asked, most_values).items():
            if n is None or n < 2:
                failed.append((table, column, "too_many_values" if n is None else "too_few_values"))
    spark = next(iter(tables.values())).sparkSession
    return local_frame(spark, failed, _FAILURE)


def ranked_categories(
    df: DataFrame, column: str, n: int = TOP_N, most_values: int = CATEGORY_LIMIT
) -> DataFrame:
    """The ``n`` most and ``n`` least frequent values of a column of 2 to ``most_values`` values.

    A column of fewer or more yields no row; ``category_failures`` names it.

    Ties go to the smaller value at the top and to the larger at the bottom.
    """
    counts = (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    # Only a column of few values passes, so the ranking is over few rows: counts beyond the
    # limit are cut before it, and a column that exceeds it yields nothing.
    few = counts.limit(most_values + 1)
    everything = W.partitionBy(F.lit(1))
    top = F.row_number().over(everything.orderBy(F.desc("occurrences"), "value"))
    bottom = F.row_number().over(everything.orderBy("occurrences", F.desc("value")))
    return (
        few.withColumns({"values": F.count(F.lit(1)).over(everything), "t": top, "b": bottom})
        .where(F.col("values").between(2, most_values))
        .where((F.col("t") <= n) | (F.col("b") <= n))
        .select("value", "occurrences", (F.col("t") <= n).alias("is_top"), (F.col("b") <= n).alias("is_bottom"))
    )


def categorical_trend(
    df: DataFrame,
    time: str,
    column: str,
    granularity: str,
    n: int = TOP_N,
    most_values: int = CATEGORY_LIMIT,
) -> DataFrame:
    """Occurrences per period of the top and bottom values, zero where a value is absent.

    Every value is drawn over the periods of the whole table.
    """
    at = as_time(df, time)
    period = period_of(at, granularity).alias("period")
    # At most 2 n values: rows of other values are dropped before anything is shuffled.
    values = ranked_categories(df, column, n, most_values).select("value")
    counts = (
        df.where(at.isNotNull())
        .select(period, col(column).alias("value"))
        .join(F.broadcast(values), "value")
        .groupBy("period", "value")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    span = df.agg(
        period_of(F.min(at), granularity).alias("first"),
        period_of(F.max(at), granularity).alias("last"),
    )
    steps = span.select(_steps(F.col("first"), F.col("last"), granularity).alias("s")).scalar()
    # At most 10 values times the calendar.
    grid = values.withColumn("period", F.explode(steps))
    return grid.join(counts, ["value", "period"], "left").select(
        "value", "period", F.coalesce("occurrences", F.lit(0)).alias("occurrences")
    )


_FAILURE = "table_name string, column_name string, reason_code string"
_TREND = (
    "table_name string, column_name string, time_column string, metric_column string,"
    "aggregation string, granularity string, period timestamp_ntz, value double"
)


def _reason() -> Column:
    """Why a wanted column has no trend, over the joined facts; null where it has one.

    The facts name what is there: a rule holds only where those before it do not.
    """
    countable = [NUMERIC, BOOLEAN]
    number_text = (F.col("metric_family") == TEXT) & (F.col("number_like_count") > 0)
    rules = {
        "no_table_prefix": F.col("table_name") == "",
        "table_missing": F.col("known").isNull(),
        "column_missing": F.col("column_family").isNull(),
        "no_time_column": F.col("time_column").isNull(),
        "no_kpi_and_not_numeric": F.col("kpi_type").isNull() & ~F.col("column_family").isin(countable),
        "metric_missing": F.col("metric_family").isNull(),
        "metric_is_time": F.col("metric_family") == DATETIME,
        "metric_is_time_column": F.col("metric") == F.col("time_column"),
        "metric_not_numeric": ~F.col("is_key") & ~F.col("metric_family").isin(countable) & ~number_text,
        "empty_result": ~F.col("is_key") & (F.col("metric_family") != BOOLEAN) & (F.col("present_count") == 0),
    }
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def _aggregation() -> Column:
    by_kpi = F.create_map(*[F.lit(x) for pair in AGGREGATION_OF_KPI.items() for x in pair])
    ends = F.col("min_value").isin(0, 1) & F.col("max_value").isin(0, 1)
    flag = (F.col("metric_family") == BOOLEAN) | (F.col("integral") & ends)
    return (
        F.when(F.col("is_key"), "count_distinct")
        .when(flag, "sum")
        .otherwise(F.coalesce(by_kpi[F.coalesce("kpi_type", F.lit("sum"))], F.lit("sum")))
    )


def plan_trends(
    tables: dict[str, DataFrame],
    columns: list[tuple[str, str]],
    overview: DataFrame | None = None,
    kpis: DataFrame | None = None,
) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """Choose metric, aggregation and granularity per column, or the reason there is none.

    The choice is a join of facts with one row per column or table and a rule for each result
    column; the driver receives the time columns and the finished plan.
    """
    known = {t: tables[t] for t in dict.fromkeys(t for t, _ in columns) if t in tables}
    if not known:
        reasons = [(t, c, "table_missing" if t else "no_table_prefix") for t, c in columns]
        return [], reasons
    spark = next(iter(known.values())).sparkSession
    overview = pin(column_overview(known)) if overview is None else overview
    kpis = kpi_suggestions(known, overview) if kpis is None else kpis
    times = primary_time_columns(known).collect()
    primary = [(r["table_name"], r["time_column"]) for r in times]
    per_table = local_frame(spark, [(t, True) for t in known], "table_name string, known boolean")
    if primary:
        grains = optimal_granularity(known, primary).select(
            "table_name", "time_column", "granularity"
        )
        per_table = per_table.join(grains, "table_name", "left")
    else:
        per_table = per_table.select(
            "*",
            F.lit(None).cast("string").alias("time_column"),
            F.lit(None).cast("string").alias("granularity"),
        )
    by_column = overview.select(
        "table_name", "column_name", F.col("family").alias("column_family"), "numeric_role"
    )
    by_metric = overview.select(
        "table_name", F.col("column_name").alias("metric"), F.col("family").alias("metric_family"),
        "integral", "min_value", "max_value", "present_count", "number_like_count",
    )
    best = best_kpis(kpis, overview).select(
        "table_name",
        "column_name",
        "kpi_type",
        F.coalesce(F.nullif("metric_column", F.lit("")), F.nullif("kpi_column", F.lit(""))).alias("drawn"),
    )
    wanted = local_frame(
        spark,
        [(i, t, c) for i, (t, c) in enumerate(columns)],
        "place int, table_name string, column_name string",
    )
    rows = (
        wanted.join(per_table, "table_name", "left")
        .join(by_column, ["table_name", "column_name"], "left")
        .join(best, ["table_name", "column_name"], "left")
        .withColumns(
            {"metric": F.coalesce("drawn", "column_name"), "is_key": key_like(F.col("column_name"))}
        )
        .join(by_metric, ["table_name", "metric"], "left")
        .select(
            "place", "table_name", "column_name", "time_column", "metric", "granularity",
            "numeric_role", _reason().alias("reason"), _aggregation().alias("aggregation"),
        )
        .orderBy("place")
        .collect()
    )
    plans = [
        {
            "table": r["table_name"],
            "column": r["column_name"],
            "time": r["time_column"],
            "metric": r["metric"],
            "aggregation": r["aggregation"],
            "granularity": r["granularity"],
            "role": r["numeric_role"],
        }
        for r in rows
        if r["reason"] is None
    ]
    failures = [(r["table_name"], r["column_name"], r["reason"]) for r in rows if r["reason"]]
    return plans, failures


def run_trends(spark, tables: dict[str, DataFrame], plans: list[dict]) -> DataFrame:
    """Draw all planned trends: per table one scan for plain aggregates, one for distincts."""
    if not plans:
        return spark.createDataFrame([], _TREND)
    parts = []
    for key in dict.fromkeys((p["table"], p["time"], p["granularity"]) for p in plans):
        table, time, grain = key
        group = [p for p in plans if (p["table"], p["time"], p["granularity"]) == key]
        df = nan_to_null(tables[table])
        df = df.where(as_time(df, time).isNotNull())
        period = period_of(as_time(df, time), grain)
        plain = [p for p in group if p["aggregation"] != "count_distinct"]
        if plain:
            cells = [
                F.struct(
                    F.lit(i).alias("i"), as_metric(df, p["metric"]).alias("value")
                )
                for i, p in enumerate(plain)
            ]
            sums = (
                df.select(period.alias("period"), F.inline(F.array(*cells)))
                .where("value IS NOT NULL")
                .groupBy("i", "period")
                .agg(*[f("value").cast("double").alias(a) for a, f in AGGREGATIONS.items()])
            )
            for how in dict.fromkeys(p["aggregation"] for p in plain):
                chosen = [i for i, p in enumerate(plain) if p["aggregation"] == how]
                points = sums.where(F.col("i").isin(chosen)).select(
                    "i", "period", F.col(how).alias("value")
                )
                parts.append(_labelled(spark, fill(points, how, grain, "i"), plain))
        distinct = [p for p in group if p["aggregation"] == "count_distinct"]
        if distinct:
            cells = [
                F.struct(F.lit(i).alias("i"), col(p["metric"]).cast("string").alias("value"))
                for i, p in enumerate(distinct)
            ]
            counts = (
                df.select(period.alias("period"), F.inline(F.array(*cells)))
                .distinct()
                .groupBy("i", "period")
                .agg(F.count("value").cast("double").alias("value"))
            )
            parts.append(_labelled(spark, counts, distinct))
    return union_all(parts)


def _labelled(spark, points: DataFrame, plans: list[dict]) -> DataFrame:
    labels = local_frame(
        spark,
        [
            (i, p["table"], p["column"], p["time"], p["metric"], p["aggregation"], p["granularity"])
            for i, p in enumerate(plans)
        ],
        "i int, table_name string, column_name string, time_column string,"
        "metric_column string, aggregation string, granularity string",
    )
    names = [f.split()[0] for f in _TREND.split(",")]
    return points.join(labels, "i").select(*names)


def trend_batch(
    spark,
    tables: dict[str, DataFrame],
    columns: list[tuple[str, str]],
    overview: DataFrame | None = None,
    kpis: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Trends of the given columns, and the columns that have none with the reason."""
    plans, failures = plan_trends(tables, columns, overview, kpis)
    return run_trends(spark, tables, plans), local_frame(spark, failures, _FAILURE)


def trend_panel(trends: DataFrame, overview: DataFrame) -> DataFrame:
    """Points to draw: empty ones dropped, each series labelled with role and settings."""
    roles = overview.select("table_name", "column_name", "numeric_role")
    label = F.concat_ws(
        " ", F.col("numeric_role"), F.col("aggregation"), F.lit("by"), F.col("granularity")
    )
    return (
        trends.where("value IS NOT NULL")
        .join(roles, ["table_name", "column_name"], "left")
        .select("table_name", "column_name", label.alias("series"), "period", "value")
    )
