"""Table and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import profile as p
from tablescout.operators.frequency import distinct_counts
from tablescout.operators.quantiles import column_quantiles
from tablescout.queries import inputs as i

QUANTILES = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
TABLES = i.PROFILED + ["doc_texts"]


def _stats(spark, sf, only=(), families=None):
    return p.column_stats(i.tables(spark, sf, i.PROFILED), only, families)


def _overview(spark, sf):
    return p.column_overview(i.tables(spark, sf, i.PROFILED))


def _table_profile(spark, sf):
    return i.rounded(p.table_profile(i.tables(spark, sf, TABLES)), 6, "duplicate_pct")


def _null_profile(spark, sf):
    stats = _stats(spark, sf).select(
        "table_name", "column_name", "row_count", "null_count", "null_pct"
    )
    return i.rounded(stats, 6, "null_pct")


def _distinct_profile(spark, sf):
    return distinct_counts(i.tables(spark, sf, i.PROFILED))


def _numeric_stats(spark, sf):
    wanted = ["min_value", "max_value", "mean_value", "std_value"]
    stats = _stats(spark, sf, wanted, ["numeric"]).select("table_name", "column_name", *wanted)
    return i.rounded(stats, 4, "mean_value", "std_value")


def _numeric_quantiles(spark, sf):
    out = column_quantiles(i.tables(spark, sf, i.PROFILED), QUANTILES)
    return i.rounded(out, 4, *QUANTILES)


def _datetime_profile(spark, sf):
    wanted = ["min_time", "max_time"]
    return _stats(spark, sf, wanted, ["datetime"]).select("table_name", "column_name", *wanted)


def _topk_values(spark, sf):
    return p.top_values(i.tables(spark, sf, i.PROFILED)).withColumn(
        "value", F.md5("value")
    )


def _numeric_role(spark, sf):
    return _overview(spark, sf).where("numeric_role IS NOT NULL").select(
        "table_name", "column_name", "distinct_count", "row_count", "numeric_role"
    )


def _numeric_role_counts(spark, sf):
    return p.numeric_role_counts(_overview(spark, sf))


def _null_panel(spark, sf):
    return p.null_panel(_stats(spark, sf))


def _table_hierarchy(spark, sf):
    return p.table_hierarchy(_stats(spark, sf).where("present_count > 0")).withColumn(
        "columns", F.concat_ws(",", "columns")
    )


def _table_summary(spark, sf):
    tables = i.tables(spark, sf, i.PROFILED)
    out = p.table_summary(_stats(spark, sf), p.top_values(tables, 5))
    one = lambda v: F.concat_ws(":", F.md5(v["value"]), v["occurrences"])
    return out.withColumn("top_values", F.array_join(F.transform("top_values", one), ","))


QUERIES = {
    "table_summary": _table_summary,
    "table_profile": _table_profile,
    "null_profile": _null_profile,
    "distinct_profile": _distinct_profile,
    "numeric_stats": _numeric_stats,
    "numeric_quantiles": _numeric_quantiles,
    "datetime_profile": _datetime_profile,
    "topk_values": _topk_values,
    "numeric_role": _numeric_role,
    "numeric_role_counts": _numeric_role_counts,
    "null_panel": _null_panel,
    "table_hierarchy": _table_hierarchy,
}


def _over(body: str) -> str:
    return i.with_inputs(i.PROFILED, body, i.overview_cte(i.PROFILED))


def _top_select(t: str, c: str) -> str:
    value = c if i.SCHEMAS[t][c] == "string" else f"CAST({c} AS VARCHAR)"
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, rank, md5(value) AS value,
      occurrences FROM (SELECT v AS value, count(*) AS occurrences, row_number() OVER
        (ORDER BY count(*) DESC, v) AS rank
        FROM (SELECT {value} AS v FROM {t}) WHERE v IS NOT NULL GROUP BY v) WHERE rank <= 10"""


SQL = {
    "table_summary": i.with_inputs(
        i.PROFILED,
        f"""SELECT table_name, column_count, column_name, coalesce(top_values, '') AS top_values
          FROM ({i.union_sql([
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {len(i.SCHEMAS[t])} AS column_count"
            for t, c in i.columns_of(i.PROFILED)
          ])})
          LEFT JOIN (SELECT table_name, column_name,
            string_agg(value || ':' || occurrences, ',' ORDER BY rank) AS top_values
            FROM tops WHERE rank <= 5 GROUP BY ALL) USING (table_name, column_name)""",
        "tops AS (" + i.union_sql([_top_select(t, c) for t, c in i.columns_of(i.PROFILED, "text", "boolean")]) + ")",
    ),
    "table_profile": i.with_inputs(
        TABLES,
        i.union_sql(
            [
                f"""SELECT '{t}' AS table_name, n AS row_count, d AS distinct_rows,
          round(1 - d / n, 6) AS duplicate_pct FROM (SELECT (SELECT count(*) FROM {t}) AS n,
          (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS d)"""
                for t in TABLES
            ]
        ),
    ),
    "null_profile": _over(
        "SELECT table_name, column_name, row_count, null_count, round(null_pct, 6) AS null_pct "
        "FROM overview"
    ),
    "distinct_profile": _over(
        "SELECT table_name, column_name, distinct_count FROM overview WHERE family <> 'other'"
    ),
    "numeric_stats": _over(
        "SELECT table_name, column_name, min_value, max_value, round(mean_value, 4) AS mean_value, "
        "round(std_value, 4) AS std_value FROM overview WHERE family = 'numeric'"
    ),
    "numeric_quantiles": i.with_inputs(
        i.PROFILED,
        i.union_sql(
            [
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                + ", ".join(
                    f"round(quantile_cont({c}::DOUBLE, {q}), 4) AS {label}"
                    for label, q in QUANTILES.items()
                )
                + f" FROM {t}"
                for t, c in i.columns_of(i.PROFILED, "numeric")
            ]
        ),
    ),
    "datetime_profile": i.with_inputs(
        i.PROFILED,
        i.union_sql(
            [
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                f"strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min_time, "
                f"strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS max_time FROM {t}"
                for t, c in i.columns_of(i.PROFILED, "datetime")
            ]
        ),
    ),
    "topk_values": i.with_inputs(
        i.PROFILED,
        i.union_sql([_top_select(t, c) for t, c in i.columns_of(i.PROFILED, "text", "boolean")]),
    ),
    "numeric_role": _over(
        "SELECT table_name, column_name, distinct_count, row_count, numeric_role FROM overview "
        "WHERE numeric_role IS NOT NULL"
    ),
    "numeric_role_counts": _over(
        "SELECT numeric_role, count(*) AS columns FROM overview WHERE numeric_role IS NOT NULL "
        "GROUP BY 1"
    ),
    "null_panel": _over(
        "SELECT table_name, column_name, round(null_pct * 100, 2) AS null_percentage FROM overview"
    ),
    "table_hierarchy": _over(
        "SELECT table_name, string_agg(column_name, ',' ORDER BY column_name) AS columns, "
        "count(*) AS column_count FROM overview WHERE present_count > 0 GROUP BY 1"
    ),
}
