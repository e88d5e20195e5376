"""Insights, priorities and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions.local import pin
from tablescout.operators import insights as n
from tablescout.operators.correlate import pearson
from tablescout.operators.kpi import kpi_suggestions
from tablescout.operators.profile import column_overview, column_stats
from tablescout.operators.relate import relationships
from tablescout.operators.validate import validation_report
from tablescout.queries import inputs as i
from tablescout.queries.kpis import kpi_ctes
from tablescout.queries.relationships import within_ctes
from tablescout.queries.scans import INSIGHT_INPUTS, INSIGHTS_CTE, pearson_cte
from tablescout.queries.validation import report_ctes

TABLES = ["customer", "events", "lineitem_corr", "orders_dirty", "part"]


def _found_insights(spark, sf):
    tables = i.tables(spark, sf, INSIGHT_INPUTS)
    return n.missingness_insights(column_stats(tables, [])).unionByName(
        n.correlation_insights(pearson(tables))
    )


def _shown(df):
    return df.withColumn("affected_columns", F.concat_ws(",", "affected_columns"))


def _missingness(spark, sf):
    return _shown(n.missingness_insights(column_stats(i.tables(spark, sf, i.PROFILED), [])))


def _correlation(spark, sf):
    return _shown(n.correlation_insights(pearson(i.tables(spark, sf, INSIGHT_INPUTS))))


def _ranked(spark, sf):
    return _shown(n.rank_insights(_found_insights(spark, sf)))


def _weighted(spark, sf):
    return _shown(n.rank_insights_weighted(_found_insights(spark, sf), full_at=50_000)).select(
        "insight_id", "score", F.round("confidence", 6).alias("confidence"), "weighted_score", "rank"
    )


def _findings(spark, sf):
    tables = i.tables(spark, sf, TABLES)
    overview = pin(column_overview(tables))
    insights = n.missingness_insights(overview).unionByName(n.correlation_insights(pearson(tables)))
    return tables, overview, insights


def _priority(spark, sf):
    tables, overview, insights = _findings(spark, sf)
    kpis = kpi_suggestions(tables, overview)
    return n.column_priority(overview, insights, kpis, relationships(tables))


def _priorities(spark, sf):
    return i.rounded(_priority(spark, sf), 6, "score")


def _top(spark, sf):
    return i.rounded(n.top_priority_columns(_priorities(spark, sf)), 6, "score")


def _tasks(spark, sf):
    tables, overview, insights = _findings(spark, sf)
    report = validation_report(tables, stats=overview)
    kpis = kpi_suggestions(tables, overview)
    return n.organize_tasks(insights, relationships(tables), report, kpis)


def _organized(spark, sf):
    out = _tasks(spark, sf).drop("topic")
    return out.withColumns(
        {
            "affected_columns": F.concat_ws(",", "affected_columns"),
            "affected_tables": F.concat_ws(",", "affected_tables"),
            "actions": F.concat_ws(" | ", "actions"),
        }
    )


def _panel(spark, sf):
    return n.task_panel(_tasks(spark, sf)).withColumn("actions", F.concat_ws(" | ", "actions"))


def _summary(spark, sf):
    out = n.task_summary(_tasks(spark, sf))
    return out.withColumns(
        {c: F.coalesce(c, F.lit("all")) for c in ("category", "priority")}
    )


def _report_tasks(spark, sf):
    tables = i.tables(spark, sf, TABLES)
    report = validation_report(tables)
    _, _, insights = _findings(spark, sf)
    return n.organize_tasks(insights, None, report, None)


def _overview(spark, sf):
    tables, overview, insights = _findings(spark, sf)
    return n.overview_stats(overview, validation_report(tables, stats=overview), insights)


QUERIES = {
    "insight_missingness": _missingness,
    "insight_correlation": _correlation,
    "ranked_insights": _ranked,
    "ranked_insights_weighted": _weighted,
    "column_priority": _priorities,
    "top_priority_columns": _top,
    "task_category": lambda spark, sf: _report_tasks(spark, sf).select("task_id", "category"),
    "task_priority": lambda spark, sf: _report_tasks(spark, sf).select(
        "task_id", "severity", "score", "priority"
    ),
    "task_actions": lambda spark, sf: _report_tasks(spark, sf).select(
        "task_id", "category", F.concat_ws(" | ", "actions").alias("actions")
    ),
    "organized_tasks": _organized,
    "task_summary": _summary,
    "task_panel": _panel,
    "overview_stats": _overview,
}


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_CATEGORY = (
    "CASE "
    + " ".join(
        f"WHEN {_any('lower(topic)', words)} THEN '{name}'"
        for name, words in n.CATEGORY_KEYWORDS.items()
    )
    + " ELSE 'optimization' END"
)
_PRIORITY = """CASE WHEN severity = 'critical' OR score >= 90 THEN 'critical'
  WHEN severity = 'high' OR score >= 70 THEN 'high'
  WHEN severity = 'medium' OR score >= 50 THEN 'medium' ELSE 'low' END"""


_ACTIONS = (
    "CASE topic "
    + " ".join(
        f"WHEN '{topic}' THEN ['{first}: ' || rationale, '{then}']"
        for topic, (first, then) in n.NEXT_STEPS.items()
    )
    + f" ELSE ['{n.LOOK_AT}: ' || rationale] END"
)
_TASKS = {
    "insights": """SELECT insight_id AS task_id, topic, title, severity, CAST(score AS DOUBLE) AS score,
      affected AS affected_columns, table_name AS affected_tables, rationale FROM insights""",
    "report": """SELECT concat_ws('_', 'validation', table_name, column_name, subtype), topic, message,
      severity, CASE severity WHEN 'high' THEN 80.0 WHEN 'medium' THEN 60.0 ELSE 40.0 END,
      coalesce(column_name, ''), table_name, message FROM report""",
    "rel": f"""SELECT 'relationship_' || source_table || '.' || source_column || '_' || target_table
        || '.' || target_column, 'relationship', 'Relationship: ' || source_table || '.' ||
        source_column || ' -> ' || target_table || '.' || target_column,
      CASE WHEN confidence = 'high' THEN 'high' ELSE 'medium' END,
      floor(round(match_rate * 100, 9)), source_column || ',' || target_column,
      source_table || ',' || target_table, 'Match rate: ' ||
        {i.percent_sql('overlap_count', 'source_unique')} || ', confidence: ' || confidence
      FROM rel WHERE match_rate >= 0.7""",
    "kpis": """SELECT 'kpi_' || kpi_type || '_' || md5(table_name || '|' || formula), 'kpi',
      description, 'low', floor(round(relevance * 100, 9)), CASE WHEN kpi_column <> '' THEN kpi_column
        ELSE array_to_string(columns, ',') END, table_name, 'Formula: ' || formula
      FROM kpis""",
}


def _tasks_cte(parts: list[str]) -> str:
    return f"""tasks AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE priority
        WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, score DESC,
        task_id) AS rank FROM (SELECT *, {_PRIORITY} AS priority, {_ACTIONS} AS actions FROM (
          SELECT *, {_CATEGORY} AS category FROM ({i.union_sql([_TASKS[p] for p in parts])}))))"""


def _with_insights(names, body, *ctes):
    return i.with_inputs(names, body, i.overview_cte(names), pearson_cte(names), INSIGHTS_CTE, *ctes)


_INSIGHT_COLUMNS = (
    "insight_id, table_name, kind, topic, title, severity, score, rationale, "
    "affected AS affected_columns, rows_seen"
)
_PEARSON_NONE = (
    "pearson(table_name, col_a, col_b, r, n) AS (SELECT '', '', '', 0::DOUBLE, 0::BIGINT WHERE false)"
)

# Everything the priorities and tasks are made of, over TABLES.
_ALL_CTES = [
    *kpi_ctes(TABLES), pearson_cte(TABLES), INSIGHTS_CTE, *within_ctes(TABLES),
    *report_ctes(TABLES)[1:],
]
_REPORT_TASKS = [
    i.overview_cte(TABLES), pearson_cte(TABLES), INSIGHTS_CTE, *report_ctes(TABLES)[1:],
    _tasks_cte(["insights", "report"]),
]
_ALL_TASKS = [*_ALL_CTES, _tasks_cte(["insights", "report", "rel", "kpis"])]

_PRIORITY_CTE = """priority AS (SELECT o.table_name, o.column_name, round(least(
      (1 - null_pct) * 0.3 + CASE numeric_role WHEN 'measure' THEN 0.1 WHEN 'dimension' THEN 0.05
        ELSE 0 END + coalesce(i.s, 0) + coalesce(k.s, 0) + coalesce(l.s, 0), 1), 6) AS score
    FROM overview o
    LEFT JOIN (SELECT table_name, column_name, least(count(*) * 0.1, 0.2) AS s FROM (SELECT
        table_name, unnest(string_split(affected, ',')) AS column_name FROM insights)
      GROUP BY 1, 2) i USING (table_name, column_name)
    LEFT JOIN (SELECT table_name, column_name, least(sum(relevance * 0.05), 0.25) AS s FROM (SELECT
        table_name, relevance, unnest(list_distinct([x for x in ([kpi_column] || columns) if x <> ''])) AS column_name FROM kpis) GROUP BY 1, 2) k USING (table_name, column_name)
    LEFT JOIN (SELECT table_name, column_name, least(sum(s), 0.15) AS s FROM (
        SELECT source_table AS table_name, source_column AS column_name, {w} AS s FROM rel
        UNION ALL SELECT target_table, target_column, {w} FROM rel) GROUP BY 1, 2) l
      USING (table_name, column_name))""".replace(
    "{w}",
    "match_rate * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 "
    "ELSE 0.2 END * 0.05",
)

SQL = {
    "insight_missingness": i.with_inputs(
        i.PROFILED,
        f"SELECT {_INSIGHT_COLUMNS} FROM insights",
        i.overview_cte(i.PROFILED),
        _PEARSON_NONE,
        INSIGHTS_CTE,
    ),
    "insight_correlation": _with_insights(
        INSIGHT_INPUTS, f"SELECT {_INSIGHT_COLUMNS} FROM insights WHERE kind = 'correlation'"
    ),
    "ranked_insights": _with_insights(
        INSIGHT_INPUTS,
        f"SELECT {_INSIGHT_COLUMNS}, row_number() OVER (ORDER BY score DESC, insight_id) AS rank "
        "FROM insights",
    ),
    "ranked_insights_weighted": _with_insights(
        INSIGHT_INPUTS,
        """SELECT insight_id, score, round(c, 6) AS confidence, round(score * c, 4) AS weighted_score,
          row_number() OVER (ORDER BY round(score * c, 4) DESC, insight_id) AS rank
        FROM (SELECT *, least(rows_seen / 50000, 1) AS c FROM insights)""",
    ),
    "column_priority": i.with_inputs(TABLES, "SELECT * FROM priority", *_ALL_CTES, _PRIORITY_CTE),
    "top_priority_columns": i.with_inputs(
        TABLES,
        "SELECT * FROM (SELECT * FROM priority ORDER BY score DESC, table_name, column_name LIMIT 10)",
        *_ALL_CTES,
        _PRIORITY_CTE,
    ),
    "task_category": i.with_inputs(TABLES, "SELECT task_id, category FROM tasks", *_REPORT_TASKS),
    "task_priority": i.with_inputs(
        TABLES, "SELECT task_id, severity, score, priority FROM tasks", *_REPORT_TASKS
    ),
    "task_actions": i.with_inputs(
        TABLES,
        "SELECT task_id, category, array_to_string(actions, ' | ') AS actions FROM tasks",
        *_REPORT_TASKS,
    ),
    "organized_tasks": i.with_inputs(
        TABLES,
        "SELECT task_id, title, severity, score, affected_columns, affected_tables, rationale, "
        "category, priority, array_to_string(actions, ' | ') AS actions, rank FROM tasks",
        *_ALL_TASKS,
    ),
    "task_summary": i.with_inputs(
        TABLES,
        "SELECT coalesce(category, 'all') AS category, coalesce(priority, 'all') AS priority, "
        "count(*) AS tasks FROM tasks GROUP BY GROUPING SETS ((category), (priority), ())",
        *_ALL_TASKS,
    ),
    "task_panel": i.with_inputs(
        TABLES,
        "SELECT category, rank, title, priority, rationale, "
        "array_to_string(actions[1:3], ' | ') AS actions FROM tasks WHERE rank <= 10",
        *_ALL_TASKS,
    ),
    "overview_stats": i.with_inputs(
        TABLES,
        "SELECT count(DISTINCT table_name) AS total_tables, count(*) AS total_columns, "
        "(SELECT count(*) FROM report) + (SELECT count(*) FROM insights) AS total_issues FROM overview",
        i.overview_cte(TABLES),
        pearson_cte(TABLES),
        INSIGHTS_CTE,
        *report_ctes(TABLES)[1:],
    ),
}
