"""Distribution summaries and guesses about what a column is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.local import pin
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
from tablescout.operators.quantiles import column_quantiles

# Fixed patterns, written so that Java and RE2 read them alike.
SENSITIVE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "phone": r"\+[0-9][0-9 ().-]{7,}[0-9]|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    "ip_address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card_number": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
}
MASK = "***"
VALUE_SET_LIMIT = 20
CATEGORY_LIMIT = 100


def histogram(tables: dict[str, DataFrame], bins: int = 10) -> DataFrame:
    """Counts of each numeric column in equal-width bins from its minimum to its maximum."""
    parts = []
    for table, df in tables.items():
        names = names_of(df, NUMERIC)
        if not names:
            continue
        labels = F.array(*[F.lit(c) for c in names])
        doubles = nan_to_null(df).select(*[col(c).cast("double").alias(c) for c in names])
        wide = doubles.agg(
            *[F.min(col(c)).alias(f"lo{i}") for i, c in enumerate(names)],
            *[F.max(col(c)).alias(f"hi{i}") for i, c in enumerate(names)],
        )
        spans = wide.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("i"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
                        for i in range(len(names))
                    ]
                )
            )
        )
        values = doubles.select(
            F.inline(
                F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(names)])
            )
        ).where("v IS NOT NULL")
        place = F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
        bin_ = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("bigint")
        # One span per numeric column.
        counts = (
            values.join(F.broadcast(spans), "i")
            .groupBy("i", bin_.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        parts.append(
            counts.select(
                F.lit(table).alias("table_name"),
                F.get(labels, F.col("i")).alias("column_name"),
                "bin",
                "n",
            )
        )
    return union_all(parts, tables, "table_name string, column_name string, bin bigint, n bigint")


def box_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Five-number summary of each numeric column."""
    return column_quantiles(
        tables, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    )


def constraint_guesses(
    overview: DataFrame, tables: dict[str, DataFrame], most_values: int = VALUE_SET_LIMIT
) -> DataFrame:
    """Not-null, unique and value-set constraints that the data satisfies today.

    A value set has at most ``most_values`` values; only columns that the overview knows to have
    so few are counted, so no free text is shuffled.
    """
    overview = pin(overview)
    keys = ["table_name", "column_name"]
    filled = overview.where("row_count > 0 AND null_count = 0")
    not_null = filled.select(*keys, F.lit("not_null").alias("constraint"), F.lit("").alias("detail"))
    unique = filled.where("distinct_count = row_count").select(
        *keys, F.lit("unique").alias("constraint"), F.lit("").alias("detail")
    )
    few = overview.where(
        (F.col("family") == TEXT) & F.col("distinct_count").between(1, most_values)
    ).select(*keys)
    small = {tuple(r) for r in few.collect()}
    texts = [
        frequencies(df, names).select(F.lit(t).alias("table_name"), "column_name", "text_key")
        for t, df in tables.items()
        if (names := [c for c in names_of(df, TEXT) if (t, c) in small])
    ]
    found = [not_null, unique]
    if texts:
        # At most ``most_values`` values are gathered in a row.
        found.append(
            union_all(texts)
            .groupBy(*keys)
            .agg(F.concat_ws(", ", F.sort_array(F.collect_list("text_key"))).alias("detail"))
            .select(*keys, F.lit("value_set").alias("constraint"), "detail")
        )
    return union_all(found)


def sensitive_columns(tables: dict[str, DataFrame], min_share: float = 0.0) -> DataFrame:
    """Share of each text column's values in which a sensitive pattern occurs."""
    parts = []
    for table, df in tables.items():
        names = names_of(df, TEXT)
        if not names:
            continue
        aggregates, rows = [], []
        for i, c in enumerate(names):
            aggregates.append(F.count(col(c)).alias(f"n{i}"))
            for kind, pattern in SENSITIVE_PATTERNS.items():
                aggregates.append(F.count_if(col(c).rlike(pattern)).alias(f"{kind}{i}"))
                rows.append(
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.lit(kind).alias("kind"),
                        F.col(f"{kind}{i}").alias("matches"),
                        F.try_divide(F.col(f"{kind}{i}"), F.col(f"n{i}")).alias("share"),
                    )
                )
        parts.append(
            df.agg(*aggregates).select(F.lit(table).alias("table_name"), F.inline(F.array(*rows)))
        )
    fields = "table_name string, column_name string, kind string, matches bigint, share double"
    found = union_all(parts, tables, fields)
    return found.where((F.col("matches") > 0) & (F.col("share") >= min_share))


def redact(c: Column) -> Column:
    """Replace every sensitive passage of a text; the whole text is searched."""
    for pattern in SENSITIVE_PATTERNS.values():
        c = F.regexp_replace(c, F.lit(pattern), F.lit(MASK))
    return c


def masked(
    df: DataFrame, redacted: list[str], hashed: list[str] | None = None, salt: str = ""
) -> DataFrame:
    """Redact passages in some columns and replace others by their salted SHA-256.

    Without a secret ``salt``, values from a small domain can be found again by trying all.
    """
    changes = {c: redact(col(c)) for c in redacted}
    changes |= {c: F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256) for c in hashed or []}
    return df.withColumns(changes)


def semantic_types(overview: DataFrame) -> DataFrame:
    """Identifier, categorical, continuous, date-time or free text."""
    kind, distinct = F.col("family"), F.col("distinct_count")
    present = F.col("present_count")
    unique = (distinct == present) & (present > 1)
    key = key_like(F.col("column_name"))
    return overview.select(
        "table_name",
        "column_name",
        F.when(kind == DATETIME, "date-time")
        .when((kind == TEXT) & (F.col("iso_date_count") > present * 0.9), "date-time")
        .when(key | (unique & (F.col("integral") | (kind == TEXT)) & (F.col("max_length") <= 64)), "identifier")
        .when(kind == BOOLEAN, "categorical")
        .when((kind == TEXT) & (distinct <= CATEGORY_LIMIT), "categorical")
        .when(kind == TEXT, "free text")
        .when(F.col("numeric_role") == "dimension", "categorical")
        .when(kind == NUMERIC, "continuous")
        .otherwise("other")
        .alias("semantic_type"),
    )


def schema_conflicts(schema: DataFrame) -> DataFrame:
    """Column names declared with different types in different tables."""
    return (
        schema.groupBy("column_name")
        .agg(
            F.concat_ws(", ", F.sort_array(F.collect_set("dtype"))).alias("dtypes"),
            F.count_distinct("dtype").alias("types"),
            F.count(F.lit(1)).alias("tables"),
        )
        .where("types > 1")
    )
