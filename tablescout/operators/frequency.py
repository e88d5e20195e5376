"""Value frequencies of many columns in one scan and one shuffle per type of key.

Each row is unpivoted into (column, typed key) pairs. Keys stay in typed slots, so integers
keep all their digits, and texts are compared in full, whatever their length. A slot is grouped
by itself: numbers then move without room for texts, and every column is still read once. Grouping by (column, key) spreads well, and a value that fills a third of the table is
reduced to one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.sqltext import ident, inline_rows, label_of, local_frame
from tablescout.functions.types import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXT,
    col,
    family,
    is_integral,
    micros_sql,
    names_of,
    nan_to_null,
    union_all,
)

KEYS = ["int_key", "float_key", "text_key"]
KINDS = ["BIGINT", "DOUBLE", "STRING"]
COUNTABLE = (NUMERIC, DATETIME, TEXT, BOOLEAN)
# Sketched counts are within a few percent; columns this many times over a limit are surely over it.
SURELY = 2


def key_slots(field: T.StructField) -> dict[str, str]:
    """The three typed key slots of one column; exactly one is set for a present value."""
    c, kind = ident(field.name), family(field.dataType)
    slots = {"int_key": "NULL", "float_key": "NULL", "text_key": "NULL"}
    if isinstance(field.dataType, T.DecimalType) or kind == BOOLEAN:
        slots["text_key"] = f"CAST({c} AS STRING)"
    elif is_integral(field.dataType):
        slots["int_key"] = c
    elif kind == NUMERIC:
        slots["float_key"] = c
    elif kind == DATETIME:
        slots["int_key"] = micros_sql(c, field.dataType)
    else:
        slots["text_key"] = c
    return slots


def _slot(field: T.StructField) -> tuple[str, str]:
    """The slot that holds the column's values, and their SQL text.

    Zone-free times stay as they are until they are grouped: turning one into a number is slow.
    """
    if isinstance(field.dataType, T.TimestampNTZType):
        return "time_key", ident(field.name)
    return next(
        (k, f"CAST({sql} AS {kind})") for (k, sql), kind in zip(key_slots(field).items(), KINDS) if sql != "NULL"
    )


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(ordinal, column_name, int_key, float_key, text_key, n)`` for the given columns."""
    names = columns if columns is not None else names_of(df, *COUNTABLE)
    micros = micros_sql("time_key", T.TimestampNTZType())
    by_slot: dict[str, list[dict[str, str]]] = {}
    for i, field in enumerate(df.schema.fields):
        if field.name in names:
            slot, sql = _slot(field)
            by_slot.setdefault(slot, []).append({"ordinal": str(i), slot: sql})
    parts = []
    for slot, rows in by_slot.items():
        values = nan_to_null(df).select(inline_rows(rows)).where(f"{slot} IS NOT NULL")
        counted = values.groupBy("ordinal", slot).agg(F.count(F.lit(1)).alias("n"))
        held = {slot: slot} if slot in KEYS else {"int_key": micros}
        keys = [f"CAST({held.get(k, 'NULL')} AS {kind}) AS {k}" for k, kind in zip(KEYS, KINDS)]
        parts.append(counted.selectExpr("ordinal", *keys, "n"))
    return union_all(parts).select(
        "ordinal", label_of("ordinal", df.columns).alias("column_name"), *KEYS, "n"
    )


def distinct_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact distinct non-missing values of every countable column."""
    parts = []
    for table, df in tables.items():
        names = names_of(df, *COUNTABLE)
        if not names:
            continue
        counts = frequencies(df, names).groupBy("column_name").agg(
            F.count(F.lit(1)).alias("distinct_count")
        )
        # An all-missing column has no keys; the label list is as long as the schema.
        all_names = local_frame(df.sparkSession, [(c,) for c in names], "column_name string")
        parts.append(
            all_names.join(counts, "column_name", "left").select(
                F.lit(table).alias("table_name"),
                "column_name",
                F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
            )
        )
    fields = "table_name string, column_name string, distinct_count bigint"
    return union_all(parts, tables, fields)


def distinct_up_to(df: DataFrame, columns: list[str], most: int) -> dict[str, int | None]:
    """Exact distinct counts of columns of at most ``most`` values; None for the others.

    One scan of distinct sketches leaves out the columns that are far beyond, so no free text is
    grouped; the others have few values and are counted.
    """
    if not columns:
        return {}
    sketched = [F.approx_count_distinct(col(c)).alias(f"d{k}") for k, c in enumerate(columns)]
    about = df.agg(*sketched).first()
    near = [c for k, c in enumerate(columns) if about[k] <= SURELY * most]
    found = dict.fromkeys(columns) | dict.fromkeys(near, 0)
    if near:
        counts = frequencies(df, near).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
        found |= {r["column_name"]: r["n"] if r["n"] <= most else None for r in counts.collect()}
    return found
