"""KPI suggestions: rules over column facts, one row per suggestion.

``table_name, kpi_column, columns, kpi_type, formula, description, relevance, value,
occurrences, time_column, metric_column``
"""

from __future__ import annotations

from itertools import combinations

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
    names_of,
    nan_to_null,
    union_all,
)
from tablescout.operators.frequency import frequencies
from tablescout.operators.profile import column_overview

DIMENSION_VALUES = (2, 100)
VALUES_EACH_END = 5

_COLUMNS = [
    "table_name",
    "kpi_column",
    "columns",
    "kpi_type",
    "formula",
    "description",
    "relevance",
    "value",
    "occurrences",
    "time_column",
    "metric_column",
]


def _kpis(df: DataFrame, **given: Column) -> DataFrame:
    empty = {
        "kpi_column": F.lit(None).cast("string"),
        "columns": F.array().cast("array<string>"),
        "value": F.lit(None).cast("string"),
        "occurrences": F.lit(None).cast("bigint"),
        "time_column": F.lit(None).cast("string"),
        "metric_column": F.lit(None).cast("string"),
    }
    chosen = {"table_name": F.col("table_name"), **empty, **given}
    return df.select(*[chosen[c].alias(c) for c in _COLUMNS])


def _rule(when: Column, kind: str, formula: str, description: str, relevance: float) -> Column:
    """A suggestion for ``column_name``; ``{}`` in the texts stands for the column."""
    name = F.col("column_name")

    def fill(text: str) -> Column:
        before, after = text.split("{}")
        return F.concat(F.lit(before), name, F.lit(after))

    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("kpi_type"),
            fill(formula).alias("formula"),
            fill(description).alias("description"),
            F.lit(relevance).alias("relevance"),
        ),
    )


def _from_rules(columns: DataFrame, rules: list[Column]) -> DataFrame:
    found = columns.select("*", F.inline(F.array_compact(F.array(*rules))))
    return _kpis(
        found,
        kpi_column=F.col("column_name"),
        kpi_type=F.col("kpi_type"),
        formula=F.col("formula"),
        description=F.col("description"),
        relevance=F.col("relevance"),
    )


def numeric_kpis(stats: DataFrame) -> DataFrame:
    """Distinct count for key-like names, otherwise sum, average, count and percentage.

    The formula and description formats and the relevances here and below are fixed values.
    """
    low, high = F.col("min_value"), F.col("max_value")
    key, plain = key_like(F.col("column_name")), ~key_like(F.col("column_name"))
    numeric = stats.where((F.col("family") == NUMERIC) & (F.col("present_count") > 0))
    return _from_rules(
        numeric,
        [
            _rule(key, "count_distinct", "COUNT(DISTINCT {})", "Distinct count of {}", 0.9),
            _rule(plain & (low >= 0) & (high > 0), "sum", "SUM({})", "Total {}", 0.8),
            _rule(plain & (F.col("std_value") > 0), "average", "AVG({})", "Average {}", 0.7),
            _rule(plain & (low >= 0), "count", "COUNT({})", "Count of {}", 0.6),
            _rule(
                plain & (low >= 0) & (high <= 1),
                "percentage", "AVG({}) * 100", "Average {} (%)", 0.9,
            ),
        ],
    )


def boolean_kpis(stats: DataFrame) -> DataFrame:
    """The number of true values."""
    flags = stats.where(F.col("family") == BOOLEAN)
    return _from_rules(
        flags, [_rule(F.lit(True), "sum", "SUM({})", "Count of {} (true values)", 0.7)]
    )


def _dimensions(overview: DataFrame) -> DataFrame:
    return overview.where(
        (F.col("family") == TEXT) & F.col("distinct_count").between(*DIMENSION_VALUES)
    )


def dimension_kpis(overview: DataFrame) -> DataFrame:
    """Grouping by text columns of 2 to 100 values."""
    name, n = F.col("column_name"), F.col("distinct_count")
    return _kpis(
        _dimensions(overview),
        kpi_column=name,
        kpi_type=F.lit("count_distinct"),
        formula=F.concat(F.lit("COUNT(DISTINCT "), name, F.lit(")")),
        description=F.concat(
            F.lit("Group by "), name, F.lit(" ("), n.cast("string"), F.lit(" distinct values)")
        ),
        relevance=F.when(n <= 20, 0.8).otherwise(0.6),
    )


def value_kpis(tables: dict[str, DataFrame], overview: DataFrame) -> DataFrame:
    """Counts of the five most and five least frequent values of each text dimension.

    Only the columns that the overview knows as dimensions are counted, so no free text is shuffled.
    """
    overview = pin(overview)
    small = {(r["table_name"], r["column_name"]) for r in _dimensions(overview).collect()}
    parts = [
        frequencies(df, names).select(
            F.lit(t).alias("table_name"), "column_name", F.col("text_key").alias("value"), "n"
        )
        for t, df in tables.items()
        if (names := [c for c in names_of(df, TEXT) if (t, c) in small])
    ]
    if not parts:
        return _kpis(
            overview.where("false"),
            kpi_type=F.lit(""), formula=F.lit(""), description=F.lit(""), relevance=F.lit(0.0),
        )
    few = _dimensions(overview).select("table_name", "column_name", "row_count")
    counts = union_all(parts).join(few, ["table_name", "column_name"])
    # Dimensions have at most 100 values, so these windows are short.
    each = W.partitionBy("table_name", "column_name")
    top = F.row_number().over(each.orderBy(F.desc("n"), "value"))
    bottom = F.row_number().over(each.orderBy("n", F.desc("value")))
    chosen = counts.withColumns({"t": top, "b": bottom}).where(
        (F.col("t") <= VALUES_EACH_END) | (F.col("b") <= VALUES_EACH_END)
    )
    name, value = F.col("column_name"), F.col("value")
    return _kpis(
        chosen,
        kpi_column=name,
        kpi_type=F.lit("count"),
        formula=F.concat(F.lit("COUNT("), name, F.lit(" = '"), value, F.lit("')")),
        description=F.concat(F.lit("Count of '"), value, F.lit("' in "), name),
        relevance=F.when(F.col("n") > F.col("row_count") * 0.1, 0.8).otherwise(0.6),
        value=value,
        occurrences=F.col("n"),
    )


def _numeric_pairs(stats: DataFrame) -> DataFrame:
    """Numeric columns of a table paired in schema order: a join of schema-sized rows."""
    numeric = stats.where((F.col("family") == NUMERIC) & (F.col("present_count") > 0))

    def side(s: str) -> DataFrame:
        return numeric.select(
            "table_name",
            F.col("column_name").alias(s),
            F.col("ordinal").alias(f"{s}_at"),
            F.col("min_value").alias(f"{s}_min"),
            F.col("max_value").alias(f"{s}_max"),
        )

    return side("a").join(side("b"), "table_name").where("a_at < b_at")


def ratio_kpis(stats: DataFrame) -> DataFrame:
    """``a / b`` where b is always positive."""
    a, b = F.col("a"), F.col("b")
    return _kpis(
        _numeric_pairs(stats).where("b_min > 0"),
        columns=F.array(a, b),
        kpi_type=F.lit("ratio"),
        formula=F.concat(a, F.lit(" / "), b),
        description=F.concat(F.lit("Ratio of "), a, F.lit(" to "), b),
        relevance=F.lit(0.7),
    )


def percentage_kpis(stats: DataFrame) -> DataFrame:
    """``a`` in percent of ``b`` where a is never negative and never above b's maximum."""
    a, b = F.col("a"), F.col("b")
    return _kpis(
        _numeric_pairs(stats).where("a_max <= b_max AND a_min >= 0"),
        columns=F.array(a, b),
        kpi_type=F.lit("percentage"),
        formula=F.concat(F.lit("("), a, F.lit(" / "), b, F.lit(") * 100")),
        description=F.concat(a, F.lit(" as percentage of "), b),
        relevance=F.lit(0.8),
    )


def trend_kpis(stats: DataFrame) -> DataFrame:
    """Every numeric column over the table's first time column."""
    first = (
        stats.where(F.col("family") == DATETIME)
        .groupBy("table_name")
        .agg(F.min_by("column_name", "ordinal").alias("at"))
    )
    metrics = stats.where(F.col("family") == NUMERIC).join(first, "table_name")
    name = F.col("column_name")
    return _kpis(
        metrics,
        columns=F.array("at", "column_name"),
        kpi_type=F.lit("trend"),
        formula=F.concat(F.lit("Trend of "), name, F.lit(" over time")),
        description=F.concat(F.lit("Time series trend of "), name),
        relevance=F.lit(0.8),
        time_column=F.col("at"),
        metric_column=name,
    )


def kpi_suggestions(
    tables: dict[str, DataFrame], overview: DataFrame | None = None
) -> DataFrame:
    """Every suggestion for every table."""
    overview = pin(column_overview(tables)) if overview is None else overview
    return union_all(
        [
            numeric_kpis(overview),
            boolean_kpis(overview),
            dimension_kpis(overview),
            value_kpis(tables, overview),
            ratio_kpis(overview),
            percentage_kpis(overview),
            trend_kpis(overview),
        ]
    )


def kpi_summary(kpis: DataFrame) -> DataFrame:
    """Suggestions per table and relevance band."""
    band = F.when(F.col("relevance") >= 0.8, "high").when(F.col("relevance") >= 0.5, "medium")
    return kpis.groupBy("table_name", band.otherwise("low").alias("band")).agg(
        F.count(F.lit(1)).alias("suggestions")
    )


def _per_column(kpis: DataFrame) -> DataFrame:
    """One row per suggestion and column it involves."""
    involved = F.array_distinct(
        F.array_compact(F.concat(F.array("kpi_column", "metric_column"), F.col("columns")))
    )
    return kpis.withColumn("column_name", F.explode(involved))


_TIES = ["kpi_type", "formula"]


def top_kpis_per_column(kpis: DataFrame, k: int = 3) -> DataFrame:
    """The most relevant suggestions that involve each column."""
    order = W.partitionBy("table_name", "column_name").orderBy(F.desc("relevance"), *_TIES)
    return (
        _per_column(kpis)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
    )


def best_kpis(kpis: DataFrame, overview: DataFrame, among: int = 10) -> DataFrame:
    """The best of each column's top suggestions after boosts for its role and for trends."""
    roles = overview.select("table_name", "column_name", "numeric_role")
    role, kind = F.col("numeric_role"), F.col("kpi_type")
    fits = ((role == "measure") & kind.isin("sum", "average", "trend")) | (
        (role == "dimension") & kind.isin("count", "percentage")
    )
    boosted = (
        F.col("relevance")
        * F.when(fits, 1.2).otherwise(1.0)
        * F.when(kind == "trend", 1.1).otherwise(1.0)
    )
    order = W.partitionBy("table_name", "column_name").orderBy(F.desc("boosted"), *_TIES)
    return (
        top_kpis_per_column(kpis, among)
        .drop("rank")
        .join(roles, ["table_name", "column_name"], "left")
        .withColumn("boosted", F.round(boosted, 6))
        .withColumn("rank", F.row_number().over(order))
        .where("rank = 1")
        .drop("rank")
    )


def _formula_values(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, formula, result)`` of every formula over one or two numeric columns."""
    parts = []
    for table, df in tables.items():
        clean = nan_to_null(df)
        numbers, flags = names_of(clean, NUMERIC), names_of(clean, BOOLEAN)
        singles: list[tuple[str, Column]] = []
        for c in numbers:
            d = col(c).cast("double")
            singles += [
                (f"SUM({c})", F.sum(d)),
                (f"AVG({c})", F.avg(d)),
                (f"AVG({c}) * 100", F.avg(d) * 100),
                (f"COUNT({c})", F.count(d).cast("double")),
            ]
        singles += [(f"SUM({c})", F.count_if(col(c)).cast("double")) for c in flags]
        if singles:
            wide = clean.agg(*[e.alias(f"f{i}") for i, (_, e) in enumerate(singles)])
            rows = [
                F.struct(F.lit(text).alias("formula"), F.col(f"f{i}").alias("result"))
                for i, (text, _) in enumerate(singles)
            ]
            parts.append(wide.select(F.lit(table).alias("table_name"), F.inline(F.array(*rows))))
        pairs = list(combinations(numbers, 2))
        if pairs:
            # A group per column pair, combined before the shuffle.
            cells = [
                F.struct(
                    F.lit(i).alias("i"),
                    col(a).cast("double").alias("a"),
                    col(b).cast("double").alias("b"),
                )
                for i, (a, b) in enumerate(pairs)
            ]
            totals = (
                clean.select(F.inline(F.array(*cells)))
                .where("a IS NOT NULL AND b IS NOT NULL")
                .groupBy("i")
                .agg(F.try_divide(F.sum("a"), F.sum("b")).alias("ratio"))
            )
            texts = local_frame(
                clean.sparkSession,
                [row for i, (a, b) in enumerate(pairs)
                 for row in ((i, f"{a} / {b}", 1.0), (i, f"({a} / {b}) * 100", 100.0))],
                "i int, formula string, scale double",
            )
            parts.append(
                texts.join(totals, "i").select(
                    F.lit(table).alias("table_name"),
                    "formula",
                    (F.col("ratio") * F.col("scale")).alias("result"),
                )
            )
    return union_all(parts, tables, "table_name string, formula string, result double")


def evaluate_kpis(
    tables: dict[str, DataFrame], kpis: DataFrame, overview: DataFrame
) -> DataFrame:
    """Suggestions with the value of their formula over the whole table.

    A ratio or percentage of two columns is that of their totals over complete rows; the count
    of a value is the number of rows that hold it. Trends are drawn by the trend operators.
    """
    distinct = overview.select(
        "table_name",
        F.concat(F.lit("COUNT(DISTINCT "), F.col("column_name"), F.lit(")")).alias("formula"),
        F.col("distinct_count").cast("double").alias("result"),
    )
    results = union_all([_formula_values(tables), distinct])
    return (
        kpis.where("kpi_type <> 'trend'")
        .join(results, ["table_name", "formula"], "left")
        .withColumn("result", F.coalesce(F.col("occurrences").cast("double"), F.col("result")))
    )


def kpi_panel(kpis: DataFrame, n: int = 12) -> DataFrame:
    """The suggestions to show first."""
    return kpis.orderBy(F.desc("relevance"), "table_name", *_TIES).limit(n)
