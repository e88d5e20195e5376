"""KPI suggestions and their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions.local import pin
from tablescout.functions.text import KEY_PATTERN
from tablescout.operators import kpi as k
from tablescout.operators.profile import column_overview, column_stats
from tablescout.queries import inputs as i

TABLES = i.CORE


def _shown(df):
    """Lists as text and no empty cells."""
    texts = {
        c: F.coalesce(c, F.lit("")) for c in ("kpi_column", "value", "time_column", "metric_column")
    }
    return df.withColumns(
        {
            **texts,
            "columns": F.concat_ws(",", "columns"),
            "occurrences": F.coalesce("occurrences", F.lit(0)),
        }
    )


def _stats(spark, sf):
    return column_stats(i.tables(spark, sf, TABLES), ["min_value", "max_value", "std_value"])


def _from_stats(rule):
    return lambda spark, sf: _shown(rule(_stats(spark, sf)))


def _dimensions(spark, sf):
    return _shown(k.dimension_kpis(column_overview(i.tables(spark, sf, TABLES))))


def _values(spark, sf):
    tables = i.tables(spark, sf, TABLES)
    return _shown(k.value_kpis(tables, column_overview(tables)))


def _all(spark, sf):
    return k.kpi_suggestions(i.tables(spark, sf, TABLES))


def _top(spark, sf):
    out = k.top_kpis_per_column(_all(spark, sf))
    return out.select("table_name", "column_name", "rank", "kpi_type", "formula", "relevance")


def _best(spark, sf):
    tables = i.tables(spark, sf, TABLES)
    overview = pin(column_overview(tables))
    out = k.best_kpis(k.kpi_suggestions(tables, overview), overview)
    return out.select("table_name", "column_name", "kpi_type", "formula", "boosted")


def _evaluated(spark, sf):
    tables = i.tables(spark, sf, TABLES)
    overview = pin(column_overview(tables))
    out = k.evaluate_kpis(tables, k.kpi_suggestions(tables, overview), overview)
    return i.rounded(out.select("table_name", "kpi_type", "formula", "result"), 3, "result")


def _panel(spark, sf):
    return _shown(k.kpi_panel(_all(spark, sf)))


QUERIES = {
    "kpi_numeric": _from_stats(k.numeric_kpis),
    "kpi_boolean": _from_stats(k.boolean_kpis),
    "kpi_dimensions": _dimensions,
    "kpi_values": _values,
    "kpi_ratio": _from_stats(k.ratio_kpis),
    "kpi_percentage": _from_stats(k.percentage_kpis),
    "kpi_trend": _from_stats(k.trend_kpis),
    "kpi_all": lambda spark, sf: _shown(_all(spark, sf)),
    "kpi_summary": lambda spark, sf: k.kpi_summary(_all(spark, sf)),
    "top_kpis_per_column": _top,
    "best_kpi_per_column": _best,
    "kpi_values_evaluated": _evaluated,
    "kpi_panel": _panel,
}

_KEY = f"regexp_matches(lower(column_name), '{KEY_PATTERN}')"


def _select(kind, formula, description, relevance, source, where, **more):
    parts = {
        "table_name": "table_name",
        "kpi_column": "''",
        "columns": "[]::VARCHAR[]",
        "kpi_type": f"'{kind}'",
        "formula": formula,
        "description": description,
        "relevance": f"CAST({relevance} AS DOUBLE)",
        "value": "''",
        "occurrences": "CAST(0 AS BIGINT)",
        "time_column": "''",
        "metric_column": "''",
        **more,
    }
    fields = ", ".join(f"{e} AS {n}" for n, e in parts.items())
    return f"SELECT {fields} FROM {source} WHERE {where}"


def _column_rule(kind, before, after, label, relevance, where):
    name, tail = label.split("{}")
    return _select(
        kind, f"'{before}' || column_name || '{after}'",
        f"'{name}' || column_name || '{tail}'", relevance, "overview", where,
        kpi_column="column_name",
    )


_NUMBER = "family = 'numeric' AND present_count > 0"
_PLAIN = f"{_NUMBER} AND NOT {_KEY}"
_PAIRS = """(SELECT a.table_name, a.column_name AS a, b.column_name AS b, a.min_value AS a_min,
  a.max_value AS a_max, b.min_value AS b_min, b.max_value AS b_max FROM overview a JOIN overview b
  ON a.table_name = b.table_name AND a.ordinal < b.ordinal WHERE a.family = 'numeric'
  AND b.family = 'numeric' AND a.present_count > 0 AND b.present_count > 0)"""
_VALUES = """(SELECT *, row_number() OVER (PARTITION BY table_name, column_name
    ORDER BY n DESC, value) AS t, row_number() OVER (PARTITION BY table_name, column_name
    ORDER BY n, value DESC) AS b FROM freq JOIN (SELECT table_name, column_name, row_count
    FROM overview WHERE family = 'text' AND distinct_count BETWEEN 2 AND 100)
    USING (table_name, column_name))"""
_RULES = {
    "kpi_numeric": [
        _column_rule("count_distinct", "COUNT(DISTINCT ", ")", "Distinct count of {}", 0.9, f"{_NUMBER} AND {_KEY}"),
        _column_rule("sum", "SUM(", ")", "Total {}", 0.8, f"{_PLAIN} AND min_value >= 0 AND max_value > 0"),
        _column_rule("average", "AVG(", ")", "Average {}", 0.7, f"{_PLAIN} AND std_value > 0"),
        _column_rule("count", "COUNT(", ")", "Count of {}", 0.6, f"{_PLAIN} AND min_value >= 0"),
        _column_rule("percentage", "AVG(", ") * 100", "Average {} (%)", 0.9, f"{_PLAIN} AND min_value >= 0 AND max_value <= 1"),
    ],
    "kpi_boolean": [
        _column_rule("sum", "SUM(", ")", "Count of {} (true values)", 0.7, "family = 'boolean'")
    ],
    "kpi_dimensions": [
        _select(
            "count_distinct", "'COUNT(DISTINCT ' || column_name || ')'",
            "'Group by ' || column_name || ' (' || distinct_count || ' distinct values)'",
            "CASE WHEN distinct_count <= 20 THEN 0.8 ELSE 0.6 END", "overview",
            "family = 'text' AND distinct_count BETWEEN 2 AND 100", kpi_column="column_name",
        )
    ],
    "kpi_values": [
        _select(
            "count", "'COUNT(' || column_name || ' = ''' || value || ''')'",
            "'Count of ''' || value || ''' in ' || column_name",
            "CASE WHEN n > row_count * 0.1 THEN 0.8 ELSE 0.6 END", _VALUES, "t <= 5 OR b <= 5",
            kpi_column="column_name", value="value", occurrences="n",
        )
    ],
    "kpi_ratio": [
        _select("ratio", "a || ' / ' || b", "'Ratio of ' || a || ' to ' || b", 0.7, _PAIRS, "b_min > 0", columns="[a, b]")
    ],
    "kpi_percentage": [
        _select(
            "percentage", "'(' || a || ' / ' || b || ') * 100'",
            "a || ' as percentage of ' || b", 0.8, _PAIRS, "a_max <= b_max AND a_min >= 0",
            columns="[a, b]",
        )
    ],
    "kpi_trend": [
        _select(
            "trend", "'Trend of ' || column_name || ' over time'",
            "'Time series trend of ' || column_name", 0.8,
            "overview JOIN (SELECT table_name, min_by(column_name, ordinal) AS at_column FROM overview "
            "WHERE family = 'datetime' GROUP BY 1) USING (table_name)",
            "family = 'numeric'",
            columns="[at_column, column_name]", time_column="at_column", metric_column="column_name",
        )
    ],
}


def kpi_ctes(names: list[str]) -> list[str]:
    return [
        i.overview_cte(names),
        i.frequency_cte(names),
        "kpis AS (" + i.union_sql([s for rules in _RULES.values() for s in rules]) + ")",
    ]


_FLAT = "* REPLACE (array_to_string(columns, ',') AS columns)"
PER_COLUMN_CTE = """per_column AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name
    ORDER BY relevance DESC, kpi_type, formula) AS rank FROM (SELECT *, unnest(list_distinct(
      [x for x in ([kpi_column, metric_column] || columns) if x <> ''])) AS column_name FROM kpis))"""


def _with(body: str, *ctes: str) -> str:
    return i.with_inputs(TABLES, body, *kpi_ctes(TABLES), *ctes)


def _results() -> str:
    parts = []
    for t in TABLES:
        numbers = [c for _, c in i.columns_of([t], "numeric")]
        for c in numbers:
            parts += [
                f"SELECT '{t}' AS table_name, unnest(['SUM({c})', 'AVG({c})', 'AVG({c}) * 100', "
                f"'COUNT({c})', 'COUNT(DISTINCT {c})']) AS formula, unnest([sum({c})::DOUBLE, "
                f"avg({c})::DOUBLE, avg({c}) * 100, count({c})::DOUBLE, count(DISTINCT {c})::DOUBLE]) "
                f"AS result FROM {t}"
            ]
        for _, c in i.columns_of([t], "text"):
            parts.append(
                f"SELECT '{t}', 'COUNT(DISTINCT {c})', count(DISTINCT {c})::DOUBLE FROM {t}"
            )
        for _, c in i.columns_of([t], "boolean"):
            parts.append(f"SELECT '{t}', 'SUM({c})', count(*) FILTER ({c})::DOUBLE FROM {t}")
        for x, a in enumerate(numbers):
            for b in numbers[x + 1 :]:
                parts.append(
                    f"SELECT '{t}', unnest(['{a} / {b}', '({a} / {b}) * 100']), unnest([r, r * 100]) "
                    f"FROM (SELECT sum({a})::DOUBLE / sum({b})::DOUBLE AS r FROM {t} "
                    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
                )
    return "results AS (" + i.union_sql(parts) + ")"


SQL = {
    **{
        name: i.with_inputs(
            TABLES,
            f"SELECT {_FLAT} FROM ({i.union_sql(rules)})",
            i.overview_cte(TABLES),
            i.frequency_cte(TABLES),
        )
        for name, rules in _RULES.items()
    },
    "kpi_all": _with(f"SELECT {_FLAT} FROM kpis"),
    "kpi_summary": _with(
        "SELECT table_name, CASE WHEN relevance >= 0.8 THEN 'high' WHEN relevance >= 0.5 "
        "THEN 'medium' ELSE 'low' END AS band, count(*) AS suggestions FROM kpis GROUP BY 1, 2"
    ),
    "top_kpis_per_column": _with(
        "SELECT table_name, column_name, rank, kpi_type, formula, relevance FROM per_column "
        "WHERE rank <= 3",
        PER_COLUMN_CTE,
    ),
    "best_kpi_per_column": _with(
        """SELECT table_name, column_name, kpi_type, formula, round(boosted, 6) AS boosted FROM (
          SELECT *, row_number() OVER (PARTITION BY table_name, column_name
            ORDER BY round(boosted, 6) DESC, kpi_type, formula) AS place FROM (SELECT p.*, relevance
            * CASE WHEN (numeric_role = 'measure' AND kpi_type IN ('sum', 'average', 'trend'))
              OR (numeric_role = 'dimension' AND kpi_type IN ('count', 'percentage')) THEN 1.2::DOUBLE
              ELSE 1 END * CASE WHEN kpi_type = 'trend' THEN 1.1::DOUBLE ELSE 1 END AS boosted
          FROM per_column p JOIN overview o USING (table_name, column_name) WHERE rank <= 10))
        WHERE place = 1""",
        PER_COLUMN_CTE,
    ),
    "kpi_values_evaluated": _with(
        """SELECT table_name, kpi_type, formula, round(CASE WHEN occurrences > 0 THEN
          occurrences::DOUBLE ELSE result END, 3) AS result
        FROM kpis LEFT JOIN results USING (table_name, formula) WHERE kpi_type <> 'trend'""",
        _results(),
    ),
    "kpi_panel": _with(
        f"SELECT {_FLAT} FROM (SELECT * FROM kpis ORDER BY relevance DESC, table_name, kpi_type, "
        "formula LIMIT 12)"
    ),
}
