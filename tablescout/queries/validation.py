"""Data quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import validate as v
from tablescout.operators.profile import column_stats, table_profile
from tablescout.queries import inputs as i

TABLES = [
    "benchmark", "contacts", "conversations", "customer", "documents", "events", "events_mixed",
    "events_text_time", "labels", "lineitem", "nation", "orders_dirty", "pages", "part", "supplier",
]
REPORTED = [
    "contacts", "customer", "documents", "events", "events_mixed", "lineitem", "nation",
    "orders_dirty", "part",
]
KEYS = {
    "orders_dirty": ["o_orderkey", "o_custkey"],
    "customer": ["c_custkey", "c_name"],
    "lineitem": ["l_orderkey"],
}
COLUMNS = [
    "table_name", "column_name", "check_type", "subtype", "severity", "n_bad", "pct_bad", "message",
]


def _shown(df):
    return i.rounded(df.select(*COLUMNS), 6, "pct_bad")


def _stats(spark, sf, only, families=None):
    return column_stats(i.tables(spark, sf, TABLES), only, families)


def _from_stats(check, stat, families=None):
    return lambda spark, sf: _shown(check(_stats(spark, sf, [stat], families)))


def _empty_strings(spark, sf):
    return i.rounded(v.blank_strings(_stats(spark, sf, ["blank_count"], ["text"])), 6, "blank_pct")


DUPLICATED = TABLES + ["doc_texts"]


def _duplicates(spark, sf):
    return _shown(v.duplicate_rows(table_profile(i.tables(spark, sf, DUPLICATED))))


def _key_uniqueness(spark, sf):
    return _shown(v.key_uniqueness(i.tables(spark, sf, list(KEYS)), KEYS))


def _referential(spark, sf):
    t = i.tables(spark, sf, ["customer", "lineitem", "orders", "orders_orphan"])
    checks = [
        v.referential_integrity(
            t["orders_orphan"], "o_custkey", t["customer"], "c_custkey", "orders_orphan", "customer"
        ),
        v.referential_integrity(
            t["lineitem"], "l_orderkey", t["orders"], "o_orderkey", "lineitem", "orders"
        ),
        v.referential_integrity(
            t["orders"], "o_orderkey", t["customer"], "c_custkey", "orders", "customer"
        ),
    ]
    return _shown(i.union(checks))


def _outliers(spark, sf):
    return _shown(v.iqr_outliers(i.tables(spark, sf, TABLES)))


def _report(spark, sf):
    return v.validation_report(i.tables(spark, sf, REPORTED))


def _panel(spark, sf):
    counts, first = v.validation_panel(_report(spark, sf))
    return counts.select(
        F.lit("count").alias("part"), "severity", F.col("checks").cast("string").alias("text")
    ).unionByName(first.select(F.lit("first").alias("part"), "severity", F.col("message").alias("text")))


QUERIES = {
    "check_completeness": _from_stats(v.completeness, "blank_count"),
    "check_empty_strings": _empty_strings,
    "check_duplicate_rows": _duplicates,
    "check_key_uniqueness": _key_uniqueness,
    "check_referential_integrity": _referential,
    "check_iqr_outliers": _outliers,
    "check_negative_values": _from_stats(v.negative_values, "negative_count", ["numeric"]),
    "check_zero_values": _from_stats(v.zero_values, "zero_count", ["numeric"]),
    "check_date_like_strings": _from_stats(v.date_like_strings, "date_like_count", ["text"]),
    "check_email_like_strings": _from_stats(v.email_like_strings, "email_like_count", ["text"]),
    "check_mixed_types": _from_stats(v.mixed_types, "number_like_count", ["text"]),
    "validation_report": lambda spark, sf: _shown(_report(spark, sf)),
    "validation_summary": lambda spark, sf: v.validation_summary(_report(spark, sf)),
    "validation_panel": _panel,
}


def _check(check_type, subtype, severity, bad, total, message, source, where, column="column_name"):
    return (
        f"SELECT table_name, {column} AS column_name, '{check_type}' AS check_type, "
        f"'{subtype}' AS subtype, {severity} AS severity, CAST({bad} AS BIGINT) AS n_bad, "
        f"({bad}) / ({total}) AS pct_bad, '{v.TOPICS[subtype]}' AS topic, {message} AS message "
        f"FROM {source} WHERE {where}"
    )


def _counted(subtype, bad, total):
    return (
        f"'{v.TOPICS[subtype]} in ' || column_name || ': ' || {bad} || ' (' || "
        f"{i.percent_sql(bad, total)} || ')'"
    )


def _share(check_type, subtype, severity, bad, family, where):
    return _check(
        check_type, subtype, f"'{severity}'", bad, "present_count",
        _counted(subtype, bad, "present_count"), "overview",
        f"family = '{family}' AND present_count > 0 AND {where}",
    )


_CHECKS = {
    "completeness": _check(
        "completeness", "completeness",
        "CASE WHEN null_pct > 0.5 THEN 'high' WHEN null_pct > 0.2 THEN 'medium' ELSE 'low' END",
        "null_count + blank_count", "row_count",
        f"'{v.TOPICS['completeness']} in ' || column_name || ': ' || "
        f"{i.percent_sql('null_count', 'row_count')} || ' null, ' || "
        f"{i.percent_sql('blank_count', 'row_count')} || ' empty'",
        "overview", "null_count > 0 OR blank_count > 0",
    ),
    "duplicates": _check(
        "uniqueness", "duplicate_rows",
        "CASE WHEN (n - d) / n > 0.1 THEN 'high' WHEN (n - d) / n > 0.05 THEN 'medium' ELSE 'low' END",
        "n - d", "n",
        f"'{v.TOPICS['duplicate_rows']} in ' || table_name || ': ' || (n - d) || ' (' || "
        f"{i.percent_sql('n - d', 'n')} || ')'",
        "row_counts", "n > d", "NULL::VARCHAR",
    ),
    "outliers": _check(
        "range", "outliers", "CASE WHEN bad / total > 0.05 THEN 'medium' ELSE 'low' END",
        "bad", "total", _counted("outliers", "bad", "total"), "outliers", "bad > 0",
    ),
    "negative": _share(
        "range", "negative_values", "low", "negative_count", "numeric",
        "negative_count / present_count > 0.01",
    ),
    "zero": _share(
        "range", "zero_values", "low", "zero_count", "numeric", "zero_count / present_count > 0.1"
    ),
    "date": _share(
        "format", "date_format", "low", "date_like_count", "text",
        "present_count > 100 AND date_like_count / present_count > 0.5",
    ),
    "email": _share(
        "format", "email_pattern", "info", "email_like_count", "text",
        "email_like_count / present_count > 0.8",
    ),
    "mixed": _share(
        "type_consistency", "mixed_types", "medium", "number_like_count", "text",
        "number_like_count / present_count > 0.1 AND number_like_count / present_count < 0.9",
    ),
}


def row_counts_cte(names):
    return "row_counts AS (" + i.union_sql(
        [
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n, "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS d"
            for t in names
        ]
    ) + ")"


def outliers_cte(names):
    return "outliers AS (" + i.union_sql(
        [
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS total,
          count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS bad
          FROM {t}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1,
            quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t}) WHERE q3 > q1"""
            for t, c in i.columns_of(names, "numeric")
        ]
    ) + ")"


REPORT_CTE = "report AS (" + i.union_sql(list(_CHECKS.values())) + ")"
_SHOWN = (
    "SELECT table_name, column_name, check_type, subtype, severity, n_bad, "
    "round(pct_bad, 6) AS pct_bad, message FROM "
)


def report_ctes(names):
    return [i.overview_cte(names), row_counts_cte(names), outliers_cte(names), REPORT_CTE]


def _stats_sql(name):
    return i.with_inputs(TABLES, f"{_SHOWN} ({_CHECKS[name]})", i.overview_cte(TABLES))


def _orphans(s, sc, t, tc):
    return f"""SELECT '{s}' AS table_name, '{sc}' AS column_name, '{t}.{tc}' AS target,
      count(*) AS total, count(*) FILTER (v NOT IN (SELECT {tc} FROM {t})) AS bad
      FROM (SELECT DISTINCT {sc} AS v FROM {s} WHERE {sc} IS NOT NULL)"""


_REPORT_BODY = {
    "validation_report": f"{_SHOWN} report",
    "validation_summary": "SELECT CASE WHEN severity IN ('critical', 'high', 'medium', 'low') "
    "THEN severity ELSE 'low' END AS severity, count(*) AS checks FROM report GROUP BY 1",
    "validation_panel": """SELECT 'count' AS part, severity, CAST(count(*) AS VARCHAR) AS text
      FROM report WHERE severity IN ('critical', 'high', 'medium', 'low') GROUP BY 2
      UNION ALL (SELECT 'first', severity, message FROM report ORDER BY CASE severity
        WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END,
        table_name, column_name NULLS FIRST, subtype LIMIT 10)""",
}

SQL = {
    "check_completeness": _stats_sql("completeness"),
    "check_empty_strings": i.with_inputs(
        TABLES,
        "SELECT table_name, column_name, blank_count, round(blank_count / row_count, 6) "
        "AS blank_pct FROM overview WHERE blank_count > 0",
        i.overview_cte(TABLES),
    ),
    "check_duplicate_rows": i.with_inputs(
        DUPLICATED, f"{_SHOWN} ({_CHECKS['duplicates']})", row_counts_cte(DUPLICATED)
    ),
    "check_key_uniqueness": i.with_inputs(
        list(KEYS),
        _SHOWN
        + "("
        + _check(
            "uniqueness", "key_uniqueness",
            "CASE WHEN d / n < 0.9 THEN 'high' ELSE 'medium' END", "n - d", "n",
            f"'{v.TOPICS['key_uniqueness']} in ' || column_name || ': ' || (n - d)",
            "("
            + i.union_sql(
                [
                    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n, "
                    f"count(DISTINCT {c}) AS d FROM {t}"
                    for t, columns in KEYS.items()
                    for c in columns
                ]
            )
            + ")",
            "d < n",
        )
        + ")",
    ),
    "check_referential_integrity": i.with_inputs(
        ["orders_orphan"],
        _SHOWN
        + "("
        + _check(
            "referential_integrity", "referential_integrity",
            "CASE WHEN bad / total > 0.1 THEN 'high' WHEN bad / total > 0.05 THEN 'medium' "
            "ELSE 'low' END",
            "bad", "total",
            f"'{v.TOPICS['referential_integrity']} in ' || table_name || '.' || column_name || "
            f"' without ' || target || ': ' || bad || ' (' || {i.percent_sql('bad', 'total')} || ')'",
            "("
            + i.union_sql(
                [
                    _orphans("orders_orphan", "o_custkey", "customer", "c_custkey"),
                    _orphans("lineitem", "l_orderkey", "orders", "o_orderkey"),
                    _orphans("orders", "o_orderkey", "customer", "c_custkey"),
                ]
            )
            + ")",
            "bad > 0",
        )
        + ")",
    ),
    "check_iqr_outliers": i.with_inputs(
        TABLES, f"{_SHOWN} ({_CHECKS['outliers']})", outliers_cte(TABLES)
    ),
    "check_negative_values": _stats_sql("negative"),
    "check_zero_values": _stats_sql("zero"),
    "check_date_like_strings": _stats_sql("date"),
    "check_email_like_strings": _stats_sql("email"),
    "check_mixed_types": _stats_sql("mixed"),
    **{
        name: i.with_inputs(REPORTED, body, *report_ctes(REPORTED))
        for name, body in _REPORT_BODY.items()
    },
}
