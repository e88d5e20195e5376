"""Tables, schemas, metadata, samples by position, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions.local import at_once, work_folder
from tablescout.operators.correlate import pearson
from tablescout.operators.incremental import incremental_profile
from tablescout.operators.insights import correlation_insights, missingness_insights, rank_insights
from tablescout.operators.profile import column_overview, column_stats
from tablescout.operators.quantiles import column_quantiles
from tablescout.queries import inputs as i
from tablescout.sources import (
    approx_cardinality,
    head_sample,
    insight_lines,
    list_tables,
    read_csv,
    read_findings,
    read_sources,
    table_metadata,
    table_schema,
    table_stats,
    write_findings,
)


def _list_tables(spark, sf):
    given = i.tables(spark, sf, i.GIVEN)
    rows = table_metadata(spark, given).select("table_name", "row_count").distinct()
    return list_tables(spark, given).join(rows, "table_name")


def _table_schema(spark, sf):
    given = i.tables(spark, sf, i.GIVEN)
    present = column_stats(given, []).select("table_name", "column_name", "present_count")
    return (
        table_schema(spark, given)
        .join(present, ["table_name", "column_name"])
        .select("table_name", "ordinal", "column_name", "dtype", "family", "present_count")
    )


def _table_stats(spark, sf):
    """Row and file counts; bytes and time as whether they are known, for both engines alike."""
    return table_stats(i.tables(spark, sf, i.GIVEN)).select(
        "table_name",
        "row_count",
        "files",
        (F.col("bytes") > 0).alias("has_bytes"),
        F.col("last_altered").isNotNull().alias("has_time"),
    )


def _table_metadata(spark, sf):
    meta = table_metadata(spark, i.tables(spark, sf, i.GIVEN))
    return meta.groupBy("table_name", "row_count").agg(F.count(F.lit(1)).alias("columns"))


def _approx_cardinality(spark, sf):
    """Whether the sketch is within three standard errors of the exact count."""
    wanted = [
        ("customer", "c_mktsegment"), ("events", "user_id"), ("lineitem", "l_partkey"),
        ("lineitem", "l_returnflag"), ("orders", "o_custkey"),
    ]
    tables = i.tables(spark, sf, sorted({t for t, _ in wanted}))
    exact = column_overview(tables).select("table_name", "column_name", "distinct_count")
    error = F.abs(F.col("approx_distinct") - F.col("distinct_count")) / F.col("distinct_count")
    return (
        approx_cardinality(tables, wanted, rsd=0.02)
        .join(exact, ["table_name", "column_name"])
        .select("table_name", "column_name", "distinct_count", (error <= 0.06).alias("within_bound"))
    )


ARCHIVED = ["events", "orders"]  # held by a second source too, every third row


def _key(name: str) -> str:
    return next(iter(i.SCHEMAS[name]))


def _source_scan(spark, sf):
    """Rows of every given table by the source that holds them, from a filter that is handed down."""
    folder = work_folder(spark)
    for name in ARCHIVED:
        i.table(spark, sf, name).where(f"{_key(name)} % 3 = 0").write.parquet(f"{folder}/{name}.parquet")
    out = []
    for name in i.GIVEN:
        rows = read_sources(spark, {"given": sf, "archive": folder}, name, [_key(name)])
        key = F.col(_key(name)).cast("bigint")
        found = rows.where(key >= 2).groupBy("source_name").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min(key).alias("first_key"),
            F.max(key).alias("last_key"),
            F.sum(key).alias("key_sum"),
        )
        out.append(found.select(F.lit(name).alias("table_name"), "*"))
    return i.union(out)


def _head_sample(spark, sf):
    top = head_sample(i.table(spark, sf, "orders"), 100, ["o_orderkey"])
    return i.timed(top, "o_orderdate")


def _all_column_profiles(spark, sf):
    tables = i.tables(spark, sf, i.PROFILED)
    quantiles = column_quantiles(tables, {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    out = column_overview(tables).join(quantiles, ["table_name", "column_name"], "left")
    return i.rounded(
        out.select(
            "table_name", "column_name", "ordinal", "dtype", "family", "row_count", "null_count",
            "null_pct", "distinct_count", "min_value", "max_value", "mean_value", "std_value",
            "p1", "p50", "p99", "numeric_role",
        ),
        4, "null_pct", "mean_value", "std_value", "p1", "p50", "p99",
    )


def _insights(spark, sf):
    tables = i.tables(spark, sf, INSIGHT_INPUTS)
    found = missingness_insights(column_stats(tables, [])).unionByName(
        correlation_insights(pearson(tables))
    )
    return rank_insights(found)


def _insight_lines(spark, sf):
    return insight_lines(_insights(spark, sf))


def _sink_roundtrip(spark, sf):
    """Findings written as JSON and read again; the folder is the session's shared one if set."""
    folder = work_folder(spark)
    stats = column_stats(i.tables(spark, sf, i.PROFILED), []).select(
        "table_name", "column_name", "row_count", "null_count"
    )
    write_findings({"stats": stats}, folder, fmt="json", by_table=True)
    back = read_findings(spark, folder, ["stats"], fmt="json")["stats"]
    return back.select("table_name", "column_name", "row_count", "null_count")


STORED = ["customer", "documents", "events", "lineitem", "orders_dirty", "part"]
_PROFILE = ["min", "max", "mean", "std"]


def _incremental_profile(spark, sf):
    """A profile after a quarter of the files was replaced and a quarter added: only these are read."""

    def profile(name):
        df = i.table(spark, sf, name)
        folder, key = work_folder(spark), F.col(f"`{df.columns[0]}`")
        dealt = df.withColumn("_part", F.pmod(key, F.lit(4)).cast("int"))
        early = dealt.where((F.col("_part") != 3) & ((F.col("_part") != 1) | (key % 8 == 1)))
        early.write.partitionBy("_part").parquet(f"{folder}/table")
        incremental_profile(spark, f"{folder}/table", f"{folder}/states").collect()  # one row per column
        later = dealt.where("_part IN (1, 3)").write.mode("overwrite").partitionBy("_part")
        later.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/table")
        found = incremental_profile(spark, f"{folder}/table", f"{folder}/states")
        return found.select(F.lit(name).alias("table_name"), "*").drop("dtype", "p50", "approx_distinct")

    parts = at_once(profile, STORED)
    return i.rounded(i.union(parts), 4, *_PROFILE)


def _csv_scan(spark, sf):
    """Orders, written as CSV and read with inferred types and a column of malformed lines."""
    path = f"{work_folder(spark)}/orders.csv"
    i.table(spark, sf, "orders").write.option("header", True).csv(path)
    read = read_csv(spark, path, corrupt="malformed")
    return i.timed(read, "o_orderdate").select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
        F.col("malformed").isNotNull().alias("malformed"),
    )


QUERIES = {
    "incremental_profile": _incremental_profile,
    "csv_scan": _csv_scan,
    "list_tables": _list_tables,
    "table_schema": _table_schema,
    "table_stats": _table_stats,
    "table_metadata": _table_metadata,
    "approx_cardinality": _approx_cardinality,
    "source_scan": _source_scan,
    "head_sample": _head_sample,
    "sink_roundtrip": _sink_roundtrip,
    "insight_lines": _insight_lines,
    "all_column_profiles": _all_column_profiles,
}


def _quantile_sql(names):
    return i.union_sql(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
            + ", ".join(
                f"quantile_cont({c}::DOUBLE, {p}) AS {label}"
                for label, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99))
            )
            + f" FROM {t}"
            for t, c in i.columns_of(names, "numeric")
        ]
    )


INSIGHTS_CTE = f"""insights AS (
  SELECT 'high_null_' || table_name || '.' || column_name AS insight_id, table_name,
    'missingness' AS kind, 'high missingness nulls' AS topic,
    'High missingness in ' || table_name || '.' || column_name AS title,
    CASE WHEN null_pct >= 0.5 THEN 'high' ELSE 'medium' END AS severity,
    round(null_pct * 100, 2) AS score,
    {i.percent_sql('null_count', 'row_count')} || ' nulls' AS rationale,
    column_name AS affected, row_count AS rows_seen
  FROM overview WHERE null_pct >= 0.2
  UNION ALL
  SELECT 'corr_' || table_name || '.' || col_a || '_' || table_name || '.' || col_b, table_name,
    'correlation', 'strong correlation',
    'Strong correlation between ' || table_name || '.' || col_a || ' and ' || table_name || '.' || col_b,
    CASE WHEN abs(r) >= 0.9 THEN 'high' ELSE 'medium' END, round(abs(r) * 100, 2),
    'Pearson r=' || printf('%.2f', abs(r)), col_a || ',' || col_b, n
  FROM pearson WHERE abs(r) >= 0.7)"""


def pearson_cte(names: list[str]) -> str:
    parts = []
    for t in names:
        columns = sorted(c for _, c in i.columns_of([t], "numeric"))
        for x, a in enumerate(columns):
            for b in columns[x + 1 :]:
                parts.append(
                    f"SELECT '{t}' AS table_name, '{a}' AS col_a, '{b}' AS col_b, "
                    f"corr({a}::DOUBLE, {b}::DOUBLE) AS r0, "
                    f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {t}"
                )
    return (
        "pearson AS (SELECT table_name, col_a, col_b, "
        "CASE WHEN r0 IS NULL OR isnan(r0) THEN 0 ELSE r0 END AS r, n FROM ("
        + i.union_sql(parts)
        + "))"
    )


INSIGHT_INPUTS = i.PROFILED + ["lineitem_corr"]

def _stored_select(t: str, c: str) -> str:
    key = next(iter(i.SCHEMAS[t]))
    kind = i.FAMILY[i.SCHEMAS[t][c]]
    number = {
        "min": f"min({c})::DOUBLE", "max": f"max({c})::DOUBLE", "mean": f"round(avg({c}::DOUBLE), 4)",
        "std": f"round(CASE WHEN count({c}) > 0 THEN coalesce(stddev_samp({c}::DOUBLE), 0) END, 4)",
    }
    time = {f"{m}_time": f"strftime({m}({c}), '%Y-%m-%d %H:%M:%S')" for m in ("min", "max")}
    cells = [
        f"{sql if kind == 'numeric' else 'NULL::DOUBLE'} AS {name}" for name, sql in number.items()
    ] + [f"{sql if kind == 'datetime' else 'NULL::VARCHAR'} AS {name}" for name, sql in time.items()]
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count,
      count(*) FILTER ({key} % 4 IN (1, 3)) AS scanned_rows, count(*) - count({c}) AS null_count,
      {", ".join(cells)} FROM {t}"""


SQL = {
    "incremental_profile": i.with_inputs(
        STORED, i.union_sql([_stored_select(t, c) for t, c in i.columns_of(STORED)])
    ),
    "csv_scan": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority,
      false AS malformed FROM orders""",
    "table_stats": i.union_sql(
        [
            f"""SELECT '{t}' AS table_name, count(*) AS row_count, CAST(1 AS BIGINT) AS files,
              true AS has_bytes, true AS has_time FROM {t}"""
            for t in i.GIVEN
        ]
    ),
    "list_tables": i.union_sql(
        [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in i.GIVEN]
    ),
    "table_schema": "WITH "
    + i.overview_cte(i.GIVEN)
    + " SELECT table_name, ordinal, column_name, dtype, family, present_count FROM overview",
    "table_metadata": i.union_sql(
        [
            f"SELECT '{t}' AS table_name, count(*) AS row_count, "
            f"CAST({len(i.SCHEMAS[t])} AS BIGINT) AS columns FROM {t}"
            for t in i.GIVEN
        ]
    ),
    "approx_cardinality": i.union_sql(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
            f"count(DISTINCT {c}) AS distinct_count, true AS within_bound FROM {t}"
            for t, c in [
                ("customer", "c_mktsegment"), ("events", "user_id"), ("lineitem", "l_partkey"),
                ("lineitem", "l_returnflag"), ("orders", "o_custkey"),
            ]
        ]
    ),
    "source_scan": i.union_sql(
        [
            f"SELECT '{t}' AS table_name, '{source}' AS source_name, count(*) AS row_count, "
            f"min({_key(t)})::BIGINT AS first_key, max({_key(t)})::BIGINT AS last_key, "
            f"sum({_key(t)})::BIGINT AS key_sum FROM {t} WHERE {_key(t)} >= 2 AND {_key(t)} % {step} = 0 HAVING count(*) > 0"
            for source, names, step in (("given", i.GIVEN, 1), ("archive", ARCHIVED, 3))
            for t in names
        ]
    ),
    "head_sample": "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) "
    "FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)",
    "sink_roundtrip": i.with_inputs(
        i.PROFILED,
        "SELECT table_name, column_name, row_count, null_count FROM overview",
        i.overview_cte(i.PROFILED),
    ),
    "insight_lines": i.with_inputs(
        INSIGHT_INPUTS,
        "SELECT row_number() OVER (ORDER BY score DESC, insight_id) AS rank, "
        "'- ' || title || ' (score ' || printf('%.2f', score) || ')' AS line FROM insights",
        i.overview_cte(INSIGHT_INPUTS),
        pearson_cte(INSIGHT_INPUTS),
        INSIGHTS_CTE,
    ),
    "all_column_profiles": i.with_inputs(
        i.PROFILED,
        "SELECT table_name, column_name, ordinal, dtype, family, row_count, null_count, "
        "round(null_pct, 4) AS null_pct, distinct_count, min_value, max_value, "
        "round(mean_value, 4) AS mean_value, round(std_value, 4) AS std_value, "
        "round(p1, 4) AS p1, round(p50, 4) AS p50, round(p99, 4) AS p99, numeric_role "
        "FROM overview LEFT JOIN quantiles USING (table_name, column_name)",
        i.overview_cte(i.PROFILED),
        "quantiles AS (" + _quantile_sql(i.PROFILED) + ")",
    ),
}
