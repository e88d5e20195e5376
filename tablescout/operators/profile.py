"""Table and column profiles."""

from __future__ import annotations

from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.sqltext import ident, inline_rows, literal
from tablescout.functions.text import (
    BLANK_PATTERN,
    DATE_MARKS,
    ISO_DATE_PATTERN,
    NUMBER_PATTERN,
)
from tablescout.functions.types import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXT,
    col,
    family,
    is_fractional,
    is_integral,
    names_of,
    nan_to_null,
    union_all,
)
from tablescout.operators.frequency import distinct_counts, frequencies
from tablescout.operators.quantiles import column_quantiles

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# A column has up to 12 fields of running totals. Spark generates no code for an aggregate of more
# than 100, and evaluates it several times slower.
COLUMNS_PER_SCAN = 5
COUNTED_PER_SCAN = 90


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def row_fingerprint(df: DataFrame) -> list[Column]:
    """128 bits that identify a row, so that whole rows need not be shuffled.

    Spark's hash skips NULLs and array ends, so null flags and lengths are hashed as values of
    their own. Maps count as equal whatever the order of their entries; other nested values are
    hashed in their JSON form.
    """
    cells = []
    for f in df.schema.fields:
        c, kind = col(f.name), f.dataType
        if is_fractional(kind):
            cells.append(c + F.lit(0).cast(kind))
        elif isinstance(kind, T.ArrayType) and not _nested(kind.elementType):
            cells += [c, F.size(c), F.transform(c, lambda x: x.isNull())]
        elif isinstance(kind, T.MapType):
            cells.append(F.to_json(F.array_sort(F.map_entries(c)), {"ignoreNullFields": "false"}))
        elif _nested(kind):
            cells.append(F.to_json(c, {"ignoreNullFields": "false"}))
        else:
            cells.append(c)
    parts = cells + [c.isNull() for c in cells]
    return [
        F.xxhash64(*parts).alias("h1"),
        F.xxhash64(F.lit(20011), *parts).alias("h2"),
    ]


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and share of rows that repeat another row."""
    parts = []
    for table, df in tables.items():
        groups = nan_to_null(df).groupBy(*row_fingerprint(df)).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            groups.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.count(F.lit(1)).alias("distinct_rows"),
            ).select(
                F.lit(table).alias("table_name"),
                "row_count",
                "distinct_rows",
                F.coalesce(
                    1 - F.try_divide(F.col("distinct_rows"), F.col("row_count")), F.lit(0.0)
                ).alias("duplicate_pct"),
            )
        )
    return union_all(parts)


def _column_aggregates(
    name: str, kind: str, fractional: bool, binary: bool = False
) -> dict[str, str]:
    """Cheap aggregates of one column; ``binary`` tells floats and doubles from decimals."""
    c = ident(name)
    out = {"present": f"count({c})"}
    if kind == NUMERIC:
        d = f"CAST({c} AS DOUBLE)"
        out |= {
            "min_value": f"min({c})",
            "max_value": f"max({c})",
            "mean_value": f"avg({d})",
            # One present value has no sample deviation: report 0.
            "std_value": f"if(count({c}) > 0, coalesce(stddev_samp({d}), 0.0D), NULL)",
            "negative_count": f"count_if({c} < 0)",
            "zero_count": f"count_if({c} = 0)",
        }
        if fractional:
            # Doubles divide slowly; from 2^52 on, and for decimals, only ``%`` is exact.
            uneven = f"{c} % 1 <> 0"
            if binary:
                uneven = f"if(abs({c}) < 4503599627370496D, {c} <> floor({c}), {uneven})"
            out["fraction_count"] = f"count_if({uneven})"
    elif kind == DATETIME:
        out |= {
            "min_time": f"date_format(min({c}), '{TIME_FORMAT}')",
            "max_time": f"date_format(max({c}), '{TIME_FORMAT}')",
        }
    elif kind == TEXT:
        out |= {
            "blank_count": f"count_if({c} RLIKE {literal(BLANK_PATTERN)})",
            "date_like_count": "count_if("
            + " OR ".join(f"contains({c}, '{mark}')" for mark in DATE_MARKS)
            + ")",
            "email_like_count": f"count_if(contains({c}, '@'))",
            "number_like_count": f"count_if({c} RLIKE {literal(NUMBER_PATTERN)})",
            "iso_date_count": f"count_if({c} RLIKE {literal(ISO_DATE_PATTERN)})",
            "max_length": f"max(length({c}))",
        }
    return out


_STAT_TYPES = {
    "min_value": "double",
    "max_value": "double",
    "mean_value": "double",
    "std_value": "double",
    "negative_count": "bigint",
    "zero_count": "bigint",
    "fraction_count": "bigint",
    "min_time": "string",
    "max_time": "string",
    "blank_count": "bigint",
    "date_like_count": "bigint",
    "email_like_count": "bigint",
    "number_like_count": "bigint",
    "iso_date_count": "bigint",
    "max_length": "bigint",
}


def column_stats(
    tables: dict[str, DataFrame],
    only: list[str] | None = None,
    families: list[str] | None = None,
) -> DataFrame:
    """One row per column with every statistic that needs no grouping; each column is read once.

    Columns are aggregated ``COLUMNS_PER_SCAN`` at a time, or ``COUNTED_PER_SCAN`` where they are
    only counted.

    ``only`` names the statistics to compute beside the counts of rows and missing values, and
    ``families`` the kinds of columns to look at; columns left out are not read.
    """
    chosen = {s: t for s, t in _STAT_TYPES.items() if only is None or s in only}
    parts = []
    wanted = [
        (table, df, list(group))
        for table, df in tables.items()
        for group in batched(
            [
                (i, f)
                for i, f in enumerate(df.schema.fields)
                if families is None or family(f.dataType) in families
            ],
            COLUMNS_PER_SCAN if chosen else COUNTED_PER_SCAN,
        )
    ]
    for table, df, fields in wanted:
        aggregates, rows = ["count(1) AS n"], []
        for i, f in fields:
            kind = family(f.dataType)
            stats = _column_aggregates(
                f.name, kind, not is_integral(f.dataType), is_fractional(f.dataType)
            )
            stats = {s: sql for s, sql in stats.items() if s == "present" or s in chosen}
            aggregates += [f"{sql} AS {stat}_{i}" for stat, sql in stats.items()]
            row = {
                "table_name": literal(table),
                "column_name": literal(f.name),
                "ordinal": str(i),
                "dtype": literal(f.dataType.simpleString()),
                "family": literal(kind),
                "integral": str(is_integral(f.dataType)),
                "row_count": "n",
                "null_count": f"n - present_{i}",
                "present_count": f"present_{i}",
            }
            for stat, dtype in chosen.items():
                empty = "0" if dtype == "bigint" else "NULL"
                value = f"{stat}_{i}" if stat in stats else empty
                row[stat] = f"coalesce(CAST({value} AS {dtype}), {empty})"
            rows.append(row)
        wide = nan_to_null(df).selectExpr(*aggregates)
        parts.append(wide.select(inline_rows(rows)))
    schema = (
        "table_name string, column_name string, ordinal int, dtype string, family string,"
        "integral boolean, row_count bigint, null_count bigint, present_count bigint"
    ) + "".join(f", {s} {t}" for s, t in chosen.items())
    null_pct = F.coalesce(F.try_divide(F.col("null_count"), F.col("row_count")), F.lit(0.0))
    return union_all(parts, tables, schema).withColumn("null_pct", null_pct)


def numeric_role() -> Column:
    """``dimension`` or ``measure`` for numeric columns, from stats and the distinct count."""
    ratio = F.try_divide(F.col("distinct_count"), F.col("row_count"))
    whole = F.col("integral") | (F.col("fraction_count") == 0)
    consecutive = F.col("max_value") - F.col("min_value") + 1 == F.col("distinct_count")
    dimension = ((ratio < 0.2) & (whole | (F.col("distinct_count") <= 10))) | (
        F.col("integral")
        & (ratio >= 0.2)
        & (ratio < 0.5)
        & (F.col("distinct_count") > 1)
        & consecutive
    )
    return F.when(
        F.col("family") == NUMERIC,
        F.when((F.col("distinct_count") > 0) & dimension, "dimension").otherwise("measure"),
    )


def column_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Column statistics with exact distinct counts and the numeric role."""
    joined = column_stats(tables).join(
        distinct_counts(tables), ["table_name", "column_name"], "left"
    )
    return joined.withColumn("numeric_role", numeric_role())


def top_values(tables: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Most frequent values of text and boolean columns; ties go to the smaller value.

    The rank filter is pushed below the shuffle, so each task ships at most ``k`` rows per
    column.
    """
    parts = []
    for table, df in tables.items():
        names = names_of(df, TEXT, BOOLEAN)
        if not names:
            continue
        order = W.partitionBy("column_name").orderBy(F.desc("n"), "text_key")
        parts.append(
            frequencies(df, names)
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select(
                F.lit(table).alias("table_name"),
                "column_name",
                F.col("rank").cast("bigint").alias("rank"),
                F.col("text_key").alias("value"),
                F.col("n").alias("occurrences"),
            )
        )
    fields = "table_name string, column_name string, rank bigint, value string, occurrences bigint"
    return union_all(parts, tables, fields)


def column_profile(tables: dict[str, DataFrame], exact_quantiles: bool = True) -> DataFrame:
    """The full profile: one row per column."""
    quantiles = column_quantiles(
        tables, {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}, exact_quantiles
    )
    tops = (
        top_values(tables)
        .groupBy("table_name", "column_name")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "occurrences"))).alias("t"))
        .select(
            "table_name",
            "column_name",
            F.transform(
                "t", lambda r: F.struct(r["value"].alias("value"), r["occurrences"].alias("count"))
            ).alias("top_k"),
        )
    )
    keys = ["table_name", "column_name"]
    return (
        column_overview(tables)
        .join(quantiles, keys, "left")
        .join(tops, keys, "left")
        .select(
            *keys,
            "ordinal",
            "dtype",
            "family",
            "row_count",
            "null_count",
            "null_pct",
            "distinct_count",
            F.col("min_value").alias("min"),
            F.col("max_value").alias("max"),
            F.col("mean_value").alias("mean"),
            F.col("std_value").alias("std"),
            "p1",
            "p5",
            "p50",
            "p95",
            "p99",
            F.col("numeric_role").alias("numeric_type"),
            F.col("min_time").alias("min_ts"),
            F.col("max_time").alias("max_ts"),
            "top_k",
        )
    )


def numeric_role_counts(overview: DataFrame) -> DataFrame:
    """How many columns are dimensions and measures."""
    return (
        overview.where(F.col("numeric_role").isNotNull())
        .groupBy("numeric_role")
        .agg(F.count(F.lit(1)).alias("columns"))
    )


def null_panel(stats: DataFrame) -> DataFrame:
    """Missing share of every column in percent."""
    return stats.select(
        "table_name", "column_name", F.round(F.col("null_pct") * 100, 2).alias("null_percentage")
    )


def table_hierarchy(stats: DataFrame) -> DataFrame:
    """Columns of each table in name order. Groups are as wide as a schema, not as the data."""
    return stats.groupBy("table_name").agg(
        F.sort_array(F.collect_list("column_name")).alias("columns"),
        F.count(F.lit(1)).alias("column_count"),
    )


def table_summary(stats: DataFrame, tops: DataFrame) -> DataFrame:
    """Every column with its most frequent values, and how many columns its table has.

    ``tops`` are top values with their rank, at most a few per column; a column without any has
    an empty list.
    """
    keys = ["table_name", "column_name"]
    width = stats.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
    listed = tops.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "occurrences"))).alias("top_values")
    )
    return (
        stats.select(*keys)
        .join(width, "table_name")
        .join(listed, keys, "left")
        .select(
            "table_name",
            "column_count",
            "column_name",
            F.coalesce("top_values", F.array().cast(listed.schema["top_values"].dataType)).alias("top_values"),
        )
    )
