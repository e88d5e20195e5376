"""Data quality checks. Each returns rows of one schema:

``table_name, column_name, check_type, subtype, severity, n_bad, pct_bad, topic, message``

``topic`` is the fixed wording of the finding without any table or column name; later rules
that look for keywords read it, so that a column called ``event_type`` is not mistaken for a
finding about types. Whole columns are examined, never a first-N prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.local import pin
from tablescout.functions.sqltext import ident, inline_rows, label_of, local_frame
from tablescout.functions.text import percent_text
from tablescout.functions.types import (
    NUMERIC,
    TEXT,
    col,
    family,
    is_integral,
    nan_to_null,
    union_all,
)
from tablescout.operators.frequency import distinct_counts
from tablescout.operators.profile import column_stats, table_profile
from tablescout.operators.quantiles import column_quantiles

SEVERITIES = ["critical", "high", "medium", "low"]

# Fixed wording per kind of finding.
TOPICS = {
    "completeness": "null or empty values",
    "duplicate_rows": "duplicate rows",
    "key_uniqueness": "duplicate key values",
    "referential_integrity": "orphaned values",
    "outliers": "outliers",
    "negative_values": "negative values",
    "zero_values": "zero values",
    "date_format": "date-like strings stored as text type",
    "email_pattern": "email addresses",
    "mixed_types": "mixed numeric and non-numeric values",
}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _finding(
    df: DataFrame,
    check_type: str,
    subtype: str,
    severity: Column,
    n_bad: Column,
    pct_bad: Column,
    message: Column,
    column: Column | None = None,
) -> DataFrame:
    return df.select(
        "table_name",
        (F.lit(None).cast("string") if column is None else column).alias("column_name"),
        F.lit(check_type).alias("check_type"),
        F.lit(subtype).alias("subtype"),
        severity.alias("severity"),
        n_bad.alias("n_bad"),
        pct_bad.alias("pct_bad"),
        F.lit(TOPICS[subtype]).alias("topic"),
        message.alias("message"),
    )


def _graded(share: Column, high: float, medium: float) -> Column:
    return F.when(share > high, "high").when(share > medium, "medium").otherwise("low")


def _named(topic: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{topic} in "), F.col("column_name"), F.lit(": "), *parts)


def completeness(stats: DataFrame) -> DataFrame:
    """Columns with any missing value or blank text, graded by the missing share."""
    nulls, blanks, rows = F.col("null_count"), F.col("blank_count"), F.col("row_count")
    found = stats.where((nulls > 0) | (blanks > 0))
    message = _named(
        TOPICS["completeness"],
        percent_text(nulls, rows),
        F.lit(" null, "),
        percent_text(blanks, rows),
        F.lit(" empty"),
    )
    return _finding(
        found,
        "completeness",
        "completeness",
        _graded(F.col("null_pct"), 0.5, 0.2),
        nulls + blanks,
        _share(nulls + blanks, rows),
        message,
        F.col("column_name"),
    )


def blank_strings(stats: DataFrame) -> DataFrame:
    """Blank share of every text column that has blank values."""
    return stats.where("blank_count > 0").select(
        "table_name",
        "column_name",
        "blank_count",
        _share(F.col("blank_count"), F.col("row_count")).alias("blank_pct"),
    )


def duplicate_rows(profile: DataFrame) -> DataFrame:
    """Rows that repeat another row, from the table profile."""
    bad = F.col("row_count") - F.col("distinct_rows")
    share = _share(bad, F.col("row_count"))
    message = F.concat(
        F.lit(f"{TOPICS['duplicate_rows']} in "),
        F.col("table_name"),
        F.lit(": "),
        bad.cast("string"),
        F.lit(" ("),
        percent_text(bad, F.col("row_count")),
        F.lit(")"),
    )
    return _finding(
        profile.where(bad > 0),
        "uniqueness",
        "duplicate_rows",
        _graded(share, 0.1, 0.05),
        bad,
        share,
        message,
    )


def key_uniqueness(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Columns expected to be unique that are not; missing values count against them."""
    picked = {
        t: nan_to_null(tables[t]).select(*[col(c) for c in columns if c in tables[t].columns])
        for t, columns in keys.items()
    }
    rows = union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(t).alias("table_name"), "row_count"
            )
            for t, df in picked.items()
        ]
    )
    counts = distinct_counts(picked).join(rows, "table_name")
    distinct, total = F.col("distinct_count"), F.col("row_count")
    return _finding(
        counts.where(distinct < total),
        "uniqueness",
        "key_uniqueness",
        F.when(_share(distinct, total) < 0.9, "high").otherwise("medium"),
        total - distinct,
        _share(total - distinct, total),
        _named(TOPICS["key_uniqueness"], (total - distinct).cast("string")),
        F.col("column_name"),
    )


def referential_integrity(
    source: DataFrame,
    source_column: str,
    target: DataFrame,
    target_column: str,
    source_name: str,
    target_name: str,
) -> DataFrame:
    """Distinct source values that the target lacks.

    Numbers are compared as numbers whatever their types, everything else as text.
    """
    types = [source.schema[source_column].dataType, target.schema[target_column].dataType]
    if all(family(t) == NUMERIC for t in types):
        shared = "bigint" if all(is_integral(t) for t in types) else "double"
    else:
        shared = "string"

    def values(df: DataFrame, name: str) -> DataFrame:
        return nan_to_null(df).select(col(name).cast(shared).alias("value")).where("value IS NOT NULL").distinct()

    wanted = values(source, source_column)
    known = values(target, target_column).withColumn("known", F.lit(1))
    # Both sides are distinct, so no key of this join is hot.
    counts = wanted.join(known, "value", "left").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("known").isNull()).alias("bad")
    )
    bad, total = F.col("bad"), F.col("distinct_values")
    share = _share(bad, total)
    message = F.concat(
        F.lit(f"{TOPICS['referential_integrity']} in {source_name}.{source_column} without "),
        F.lit(f"{target_name}.{target_column}: "),
        bad.cast("string"),
        F.lit(" ("),
        percent_text(bad, total),
        F.lit(")"),
    )
    return _finding(
        counts.where("bad > 0").withColumn("table_name", F.lit(source_name)),
        "referential_integrity",
        "referential_integrity",
        _graded(share, 0.1, 0.05),
        bad,
        share,
        message,
        F.lit(source_column),
    )


def iqr_bounds(tables: dict[str, DataFrame]) -> DataFrame:
    """Quartiles and the 1.5 IQR fences of every numeric column with a positive IQR."""
    quartiles = column_quantiles(tables, {"q1": 0.25, "q3": 0.75})
    width = F.col("q3") - F.col("q1")
    return quartiles.where(width > 0).select(
        "table_name",
        "column_name",
        "q1",
        "q3",
        (F.col("q1") - 1.5 * width).alias("lower_bound"),
        (F.col("q3") + 1.5 * width).alias("upper_bound"),
    )


def outlier_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside the IQR fences per numeric column."""
    # Two numbers per numeric column, read by one count per table.
    fences: dict[str, list[tuple]] = {}
    for r in iqr_bounds(tables).collect():
        fences.setdefault(r["table_name"], []).append(
            (r["column_name"], r["lower_bound"], r["upper_bound"])
        )
    parts = []
    for table, rows in fences.items():
        df = tables[table]
        names = [name for name, _, _ in rows]
        values = nan_to_null(df).select(
            inline_rows(
                [{"i": str(i), "v": f"CAST({ident(c)} AS DOUBLE)"} for i, c in enumerate(names)]
            )
        )
        edges = local_frame(
            df.sparkSession,
            [(i, low, high) for i, (_, low, high) in enumerate(rows)],
            "i int, lower_bound double, upper_bound double",
        )
        counted = (
            values.where("v IS NOT NULL")
            .join(F.broadcast(edges), "i")
            .groupBy("i")
            .agg(
                F.count(F.lit(1)).alias("present_count"),
                F.expr("count_if(v < lower_bound OR v > upper_bound)").alias("outliers"),
            )
        )
        parts.append(
            counted.select(
                F.lit(table).alias("table_name"),
                label_of("i", names).alias("column_name"),
                "present_count",
                "outliers",
            )
        )
    fields = "table_name string, column_name string, present_count bigint, outliers bigint"
    return union_all(parts, tables, fields)


def iqr_outliers(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns with values outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR."""
    bad, total = F.col("outliers"), F.col("present_count")
    share = _share(bad, total)
    return _finding(
        outlier_counts(tables).where("outliers > 0"),
        "range",
        "outliers",
        F.when(share > 0.05, "medium").otherwise("low"),
        bad,
        share,
        _named(TOPICS["outliers"], bad.cast("string"), F.lit(" ("), percent_text(bad, total), F.lit(")")),
        F.col("column_name"),
    )


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` lies outside the IQR fences, with the fences."""
    bounds = iqr_bounds({"t": df.select(col(column))}).select("lower_bound", "upper_bound")
    fences = bounds.select(F.struct("lower_bound", "upper_bound")).scalar()
    flagged = nan_to_null(df).withColumn("_fences", fences)
    low, high = F.col("_fences.lower_bound"), F.col("_fences.upper_bound")
    value = col(column).cast("double")
    return (
        flagged.where((value < low) | (value > high))
        .withColumns({"lower_bound": low, "upper_bound": high})
        .drop("_fences")
    )


def _counted_share(
    stats: DataFrame, kind: str, check_type: str, subtype: str, severity: str, part: str, over: float
) -> DataFrame:
    bad, total = F.col(part), F.col("present_count")
    share = _share(bad, total)
    found = stats.where((F.col("family") == kind) & (share > over))
    return _finding(
        found,
        check_type,
        subtype,
        F.lit(severity),
        bad,
        share,
        _named(TOPICS[subtype], bad.cast("string"), F.lit(" ("), percent_text(bad, total), F.lit(")")),
        F.col("column_name"),
    )


def negative_values(stats: DataFrame) -> DataFrame:
    """Numeric columns with more than 1 % negative values."""
    return _counted_share(stats, NUMERIC, "range", "negative_values", "low", "negative_count", 0.01)


def zero_values(stats: DataFrame) -> DataFrame:
    """Numeric columns with more than 10 % zeros."""
    return _counted_share(stats, NUMERIC, "range", "zero_values", "low", "zero_count", 0.1)


def date_like_strings(
    stats: DataFrame, strict: bool = False, more_than: int = 100
) -> DataFrame:
    """Text columns of more than ``more_than`` values where most contain a dash, slash or T.

    ``strict`` counts only values that start with an ISO date.
    """
    counted = "iso_date_count" if strict else "date_like_count"
    return _counted_share(
        stats.where(F.col("present_count") > more_than), TEXT, "format", "date_format", "low", counted, 0.5
    )


def email_like_strings(stats: DataFrame) -> DataFrame:
    """Text columns where more than 80 % of the values contain an at sign."""
    return _counted_share(stats, TEXT, "format", "email_pattern", "info", "email_like_count", 0.8)


def mixed_types(stats: DataFrame) -> DataFrame:
    """Text columns where between 10 % and 90 % of the values read as numbers."""
    share = _share(F.col("number_like_count"), F.col("present_count"))
    return _counted_share(
        stats.where(share < 0.9),
        TEXT, "type_consistency", "mixed_types", "medium", "number_like_count", 0.1,
    )


def validation_report(
    tables: dict[str, DataFrame],
    keys: dict[str, list[str]] | None = None,
    stats: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Every check over every table; column and table facts already at hand can be passed."""
    stats = pin(column_stats(tables)) if stats is None else stats
    checks = [
        completeness(stats),
        duplicate_rows(table_profile(tables) if profile is None else profile),
        iqr_outliers(tables),
        negative_values(stats),
        zero_values(stats),
        date_like_strings(stats),
        email_like_strings(stats),
        mixed_types(stats),
    ]
    if keys:
        checks.append(key_uniqueness(tables, keys))
    return union_all(checks)


def validation_summary(report: DataFrame) -> DataFrame:
    """Findings per severity; whatever is not critical, high or medium counts as low."""
    named = F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("low")
    return report.groupBy(named.alias("severity")).agg(F.count(F.lit(1)).alias("checks"))


def validation_panel(report: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts for the four shown severities, and the ``k`` findings to read first."""
    counts = (
        report.where(F.col("severity").isin(SEVERITIES))
        .groupBy("severity")
        .agg(F.count(F.lit(1)).alias("checks"))
    )
    grade = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    rank = F.when(grade == 0, 5).otherwise(grade)
    first = report.orderBy(rank, "table_name", "column_name", "subtype").limit(k)
    return counts, first.select("severity", "message")
