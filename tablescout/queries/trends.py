"""Metrics over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions.local import pin
from tablescout.operators import trends as t
from tablescout.operators.profile import column_overview, column_stats
from tablescout.queries import inputs as i

FORMAT = "%Y-%m-%d %H:%M:%S"


def _trend(table, time, metric, how, grain, fill=False, digits=4):
    def query(spark, sf):
        points = t.trend(i.table(spark, sf, table), time, metric, how, grain, fill)
        out = points.withColumn("value", F.round(F.col("value").cast("double"), digits))
        return i.timed(out, "period")

    return query


_AGG = {
    "sum": "sum({})", "avg": "avg({})", "count": "count({})", "min": "min({})", "max": "max({})",
    "count_distinct": "count(DISTINCT {})",
}


def _trend_sql(table, time, metric, how, grain, fill=False, digits=4):
    value = f"CAST({metric} AS DOUBLE)" if how != "count_distinct" else metric
    if i.SCHEMAS.get(table, {}).get(metric) == "boolean":
        value = f"CAST(coalesce(CAST({metric} AS INTEGER), 0) AS DOUBLE)"
    kept = "" if how == "count_distinct" else f" AND {value} IS NOT NULL"
    points = (
        f"SELECT date_trunc('{grain}', {time}) AS period, {_AGG[how].format(value)} AS value "
        f"FROM {table} WHERE {time} IS NOT NULL{kept} GROUP BY 1"
    )
    if fill:
        zero = "v.value" if how in ("avg", "min", "max") else "coalesce(v.value, 0)"
        points = (
            f"SELECT g.period, {zero} AS value FROM (SELECT unnest(generate_series(min(period), "
            f"max(period), INTERVAL 1 {grain})) AS period FROM points) g "
            "LEFT JOIN points v USING (period)"
        ).replace("FROM points", f"FROM ({points})").replace("JOIN points", f"JOIN ({points})")
    return i.with_inputs(
        [table],
        f"SELECT strftime(period, '{FORMAT}') AS period, "
        f"round(CAST(value AS DOUBLE), {digits}) AS value FROM ({points})",
    )


TRENDS = {
    "trend_sum": ("events", "ts", "value", "sum", "day"),
    "trend_avg": ("events", "ts", "value", "avg", "day"),
    "trend_count": ("orders_dirty", "o_orderdate", "o_totalprice", "count", "month"),
    "trend_min": ("lineitem", "l_shipdate", "l_extendedprice", "min", "month"),
    "trend_max": ("lineitem", "l_shipdate", "l_extendedprice", "max", "month"),
    "trend_count_distinct": ("events", "ts", "user_id", "count_distinct", "day"),
    "trend_gap_filled": ("events_sparse", "ts", "value", "sum", "hour", True),
    "trend_hourly": ("events", "ts", "value", "sum", "hour"),
    "trend_daily": ("orders", "o_orderdate", "o_totalprice", "sum", "day"),
    "trend_monthly": ("orders", "o_orderdate", "o_totalprice", "sum", "month"),
    "trend_yearly": ("orders", "o_orderdate", "o_totalprice", "sum", "year"),
    "trend_boolean_sum": ("orders_dirty", "o_orderdate", "is_urgent", "sum", "month"),
}


def _weekly(spark, sf):
    """Both labels of a week: its Monday and its Sunday."""
    points = t.trend(i.table(spark, sf, "events"), "ts", "value", "sum", "week")
    labelled = points.withColumns(
        {
            "period_end": t.period_end(F.col("period"), "week"),
            "value": F.round("value", 4),
        }
    )
    return i.timed(labelled, "period", "period_end")


TIMED = [*i.GIVEN, "events_text_time"]


def _primary_time(spark, sf):
    return t.primary_time_columns(i.tables(spark, sf, TIMED))


def _time_columns(spark, sf):
    stats = column_stats(
        i.tables(spark, sf, i.PROFILED), ["min_time", "max_time"], ["datetime"]
    )
    return t.time_columns(stats).join(
        stats.select("table_name", "column_name", "present_count", "min_time", "max_time"),
        ["table_name", "column_name"],
    )


GRAINS = [
    ("events", "ts"), ("events_text_time", "ts"), ("lineitem", "l_shipdate"),
    ("orders", "o_orderdate"),
]


def _granularity(spark, sf):
    names = sorted({name for name, _ in GRAINS})
    return t.optimal_granularity(i.tables(spark, sf, names), GRAINS)


BATCH = [
    ("events", "value"), ("events", "user_id"), ("lineitem", "l_extendedprice"),
    ("lineitem", "l_tax"), ("lineitem", "l_linenumber"), ("orders_dirty", "o_totalprice"),
    ("orders_dirty", "is_urgent"),
]
FAILING = [
    ("part", "p_size"), ("orders_dirty", "o_orderpriority"), ("lineitem", "l_returnflag"),
    ("events", "missing"), ("missing", "value"), ("", "value"),
]
# What the rules choose for BATCH: metric, aggregation, period.
CHOSEN = {
    ("events", "value"): ("ts", "sum", "day"),
    ("events", "user_id"): ("ts", "count_distinct", "day"),
    ("lineitem", "l_extendedprice"): ("l_shipdate", "sum", "year"),
    ("lineitem", "l_tax"): ("l_shipdate", "avg", "year"),
    ("lineitem", "l_linenumber"): ("l_shipdate", "avg", "year"),
    ("orders_dirty", "o_totalprice"): ("o_orderdate", "sum", "year"),
    ("orders_dirty", "is_urgent"): ("o_orderdate", "sum", "year"),
}


def _batch_tables(spark, sf):
    return i.tables(spark, sf, ["events", "lineitem", "orders_dirty", "part"])


def _batch(spark, sf):
    trends, _ = t.trend_batch(spark, _batch_tables(spark, sf), BATCH)
    return i.timed(trends.withColumn("value", F.round("value", 3)), "period")


def _failures(spark, sf):
    return t.trend_batch(spark, _batch_tables(spark, sf), FAILING)[1]


def _panel(spark, sf):
    tables = _batch_tables(spark, sf)
    overview = pin(column_overview(tables))
    trends, _ = t.trend_batch(spark, tables, BATCH, overview)
    panel = t.trend_panel(trends, overview)
    return i.timed(panel.withColumn("value", F.round("value", 3)), "period")


CATEGORIES = [
    ("events", "ts", "event_type", "week"), ("lineitem", "l_shipdate", "l_returnflag", "year"),
    ("orders_dirty", "o_orderdate", "o_orderstatus", "month"),
]


def _categorical(spark, sf):
    parts = []
    for table, time, column, grain in CATEGORIES:
        points = t.categorical_trend(i.table(spark, sf, table), time, column, grain)
        parts.append(points.select(F.lit(f"{table}.{column}").alias("series"), "*"))
    return i.timed(i.union(parts), "period")


RANKED = [("part", "p_brand"), ("part", "p_type"), ("nation", "n_name"), ("orders", "o_orderpriority")]


def _top_bottom(spark, sf):
    parts = [
        t.ranked_categories(i.table(spark, sf, table), column).select(
            F.lit(f"{table}.{column}").alias("series"), "*"
        )
        for table, column in RANKED
    ]
    return i.union(parts)


UNDRAWN = i.columns_of(i.PROFILED, "text")


def _category_failures(spark, sf):
    return t.category_failures(i.tables(spark, sf, i.PROFILED), UNDRAWN)


def _trailing(spark, sf):
    recent = t.trailing_years(i.table(spark, sf, "orders"), "o_orderdate", 2)
    points = t.trend(recent, "o_orderdate", "o_totalprice", "sum", "month")
    return i.timed(i.rounded(points, 4, "value"), "period")


QUERIES = {
    "primary_time_column": _primary_time,
    "time_columns": _time_columns,
    "optimal_granularity": _granularity,
    **{name: _trend(*spec) for name, spec in TRENDS.items()},
    "trend_weekly": _weekly,
    "trend_batch": _batch,
    "trend_failures": _failures,
    "trend_panel": _panel,
    "categorical_trend": _categorical,
    "category_failures": _category_failures,
    "top_bottom_values": _top_bottom,
    "trend_trailing_2y": _trailing,
}


def _primary_select(table):
    checks = [
        (k, c, f"CAST(min({c}) AS VARCHAR)" if kind == "timestamp_ntz" else f"min(TRY_CAST({c} AS TIMESTAMP))::VARCHAR")
        for k, (c, kind) in enumerate(i.SCHEMAS[table].items())
        if kind in ("timestamp_ntz", "string")
    ]
    rows = " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS c, {e} AS found FROM {table}" for k, c, e in checks)
    return (
        f"SELECT '{table}' AS table_name, min_by(c, k) AS time_column FROM ({rows}) "
        "WHERE found IS NOT NULL HAVING count(*) > 0"
    )


def _grain_select(table, time):
    at = time if i.SCHEMAS[table][time] == "timestamp_ntz" else f"TRY_CAST({time} AS TIMESTAMP)"
    return f"""SELECT '{table}' AS table_name, '{time}' AS time_column, n AS points, CASE
      WHEN n < 2 THEN 'day' WHEN s < 86400 AND n > 10 THEN 'hour' WHEN d < 7 THEN 'day'
      WHEN d < 90 THEN CASE WHEN n / greatest(d, 1) < 0.5 THEN 'week' ELSE 'day' END
      WHEN d < 365 THEN CASE WHEN n / greatest(d, 1) < 0.1 THEN 'month' ELSE 'week' END
      WHEN d < 1095 THEN 'month' ELSE 'year' END AS granularity
      FROM (SELECT count(t) AS n, epoch(max(t)) - epoch(min(t)) AS s,
        floor((epoch(max(t)) - epoch(min(t))) / 86400) AS d FROM (SELECT {at} AS t FROM {table}))"""


def _batch_select(table, column, with_role):
    time, how, grain = CHOSEN[table, column]
    value = _AGG[how].format(f"coalesce(CAST({column} AS INTEGER), 0)" if column == "is_urgent" else column)
    kept = "" if how == "count_distinct" or column == "is_urgent" else f"WHERE {column} IS NOT NULL"
    settings = (
        f"'{how} by {grain}' AS series"
        if with_role
        else f"'{time}' AS time_column, '{column}' AS metric_column, '{how}' AS aggregation, "
        f"'{grain}' AS granularity"
    )
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {settings},
      strftime(date_trunc('{grain}', {time}), '{FORMAT}') AS period,
      round(CAST({value} AS DOUBLE), 3) AS value FROM {table} {kept} GROUP BY period"""


def _ranked_sql(table, column):
    return f"""SELECT '{table}.{column}' AS series, v AS value, n AS occurrences, t <= 5 AS is_top,
      b <= 5 AS is_bottom FROM (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS t,
        row_number() OVER (ORDER BY n, v DESC) AS b, count(*) OVER () AS values
        FROM (SELECT {column} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1))
      WHERE values BETWEEN 2 AND 100 AND (t <= 5 OR b <= 5)"""


def _categorical_select(table, time, column, grain):
    return f"""SELECT g.series, g.value, strftime(g.period, '{FORMAT}') AS period,
      count(c.v) AS occurrences FROM (SELECT series, value, period FROM
        ({_ranked_sql(table, column)}), (SELECT unnest(generate_series(min(date_trunc('{grain}', {time})),
          max(date_trunc('{grain}', {time})), INTERVAL 1 {grain})) AS period FROM {table})) g
      LEFT JOIN (SELECT {column} AS v, date_trunc('{grain}', {time}) AS p FROM {table}) c
        ON c.v = g.value AND c.p = g.period GROUP BY 1, 2, 3"""


_BATCH_INPUTS = ["orders_dirty"]
_REASONS = {
    ("part", "p_size"): "no_time_column",
    ("orders_dirty", "o_orderpriority"): "metric_not_numeric",
    ("lineitem", "l_returnflag"): "metric_not_numeric",
    ("events", "missing"): "column_missing",
    ("missing", "value"): "table_missing",
    ("", "value"): "no_table_prefix",
}

SQL = {
    "primary_time_column": i.with_inputs(
        TIMED, i.union_sql([_primary_select(x) for x in TIMED if i.columns_of([x], "datetime", "text")])
    ),
    "time_columns": i.with_inputs(
        i.PROFILED,
        i.union_sql(
            [
                f"SELECT '{x}' AS table_name, '{c}' AS column_name, "
                f"{list(i.SCHEMAS[x]).index(c)} AS ordinal, count({c}) AS present_count, "
                f"strftime(min({c}), '{FORMAT}') AS min_time, strftime(max({c}), '{FORMAT}') AS max_time "
                f"FROM {x}"
                for x, c in i.columns_of(i.PROFILED, "datetime")
            ]
        ),
    ),
    "optimal_granularity": i.with_inputs(
        ["events_text_time"], i.union_sql([_grain_select(*g) for g in GRAINS])
    ),
    **{name: _trend_sql(*spec) for name, spec in TRENDS.items()},
    "trend_weekly": f"""SELECT strftime(p, '{FORMAT}') AS period,
      strftime(p + INTERVAL 6 DAY, '{FORMAT}') AS period_end, round(v, 4) AS value FROM
      (SELECT date_trunc('week', ts) AS p, sum(value) AS v FROM events GROUP BY 1)""",
    "trend_batch": i.with_inputs(
        _BATCH_INPUTS, i.union_sql([_batch_select(*b, False) for b in BATCH])
    ),
    "trend_failures": i.union_sql(
        [
            f"SELECT '{x}' AS table_name, '{c}' AS column_name, '{reason}' AS reason_code"
            for (x, c), reason in _REASONS.items()
        ]
    ),
    "trend_panel": i.with_inputs(
        _BATCH_INPUTS,
        "SELECT table_name, column_name, CASE WHEN numeric_role IS NULL THEN series ELSE "
        "numeric_role || ' ' || series END AS series, period, value FROM ("
        + i.union_sql([_batch_select(*b, True) for b in BATCH])
        + ") JOIN (SELECT table_name, column_name, numeric_role FROM overview) "
        "USING (table_name, column_name)",
        i.overview_cte(["events", "lineitem", "orders_dirty"]),
    ),
    "category_failures": i.with_inputs(
        i.PROFILED,
        "SELECT * FROM ("
        + i.union_sql(
            [
                f"""SELECT '{x}' AS table_name, '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) > 100
          THEN 'too_many_values' WHEN count(DISTINCT {c}) < 2 THEN 'too_few_values' END AS reason_code FROM {x}"""
                for x, c in UNDRAWN
            ]
        )
        + ") WHERE reason_code IS NOT NULL",
    ),
    "categorical_trend": i.with_inputs(
        _BATCH_INPUTS, i.union_sql([_categorical_select(*c) for c in CATEGORIES])
    ),
    "top_bottom_values": i.union_sql([_ranked_sql(*x) for x in RANKED]),
    "trend_trailing_2y": f"""SELECT strftime(date_trunc('month', o_orderdate), '{FORMAT}') AS period,
      round(sum(o_totalprice), 4) AS value FROM orders
      WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 2 YEAR FROM orders) GROUP BY 1""",
}
