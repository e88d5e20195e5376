"""Association of text columns from their contingency tables, and entropy."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.local import settle, work_folder
from tablescout.functions.sqltext import local_frame
from tablescout.functions.tails import chi_square_p
from tablescout.functions.types import TEXT, col, names_of, union_all
from tablescout.operators.frequency import frequencies


def contingency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(pair, a, b, n)`` for every pair of text columns in one scan and one shuffle."""
    return _counted(_together(df, _pairs(df, columns)))


def _pairs(df: DataFrame, columns: list[str] | None) -> list[tuple[str, str]]:
    return list(combinations(sorted(columns if columns is not None else names_of(df, TEXT)), 2))


def _together(df: DataFrame, pairs: list[tuple[str, str]], first: int = 0) -> DataFrame:
    """``(pair, a, b)`` of every row and pair; pairs are numbered from ``first`` on."""
    rows = [
        F.struct(F.lit(i).alias("pair"), col(a).alias("a"), col(b).alias("b"))
        for i, (a, b) in enumerate(pairs, first)
    ]
    return df.select(F.inline(F.array(*rows))).where("a IS NOT NULL AND b IS NOT NULL")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def associations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chi-square with p-value, Cramér's V and mutual information per column pair.

    With row totals R, column totals C and cells O: chi2 = n (sum O^2 / (R C) - 1), so only
    occurring cells are needed. Totals are joined back, never windowed: a value that fills
    most of a column is one row of its totals.
    """
    pairs = _pairs(df, columns)
    found = _measured(_counted(_together(df, pairs)), [("", a, b) for a, b in pairs])
    return found.drop("table_name")


def table_associations(tables: dict[str, DataFrame]) -> DataFrame:
    """``associations`` of all column pairs of every table, in one shuffle of them all.

    Takes frames of text columns.
    """
    parts, labels = [], []
    for table, df in tables.items():
        if pairs := _pairs(df, df.columns):
            parts.append(_together(df, pairs, len(labels)))
            labels += [(table, a, b) for a, b in pairs]
    return _measured(_counted(union_all(parts, tables, "pair int, a string, b string")), labels)


def _measured(cells: DataFrame, labels: list[tuple[str, str, str]]) -> DataFrame:
    # Read for both totals and for the sums: without this, all pairs of all rows are counted again.
    cells = settle(cells, work_folder(cells.sparkSession), "cells")
    rows = cells.groupBy("pair", "a").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("pair", "b").agg(F.sum("n").alias("c"))
    shape = (
        rows.groupBy("pair")
        .agg(F.count(F.lit(1)).alias("n_a"), F.sum("r").alias("total"))
        .join(cols.groupBy("pair").agg(F.count(F.lit(1)).alias("n_b")), "pair")
    )
    n, r, c = (F.col(x).cast("double") for x in ("n", "r", "c"))
    sums = (
        cells.join(rows, ["pair", "a"])
        .join(cols, ["pair", "b"])
        .groupBy("pair")
        .agg(
            F.sum(n * n / (r * c)).alias("ratio"),
            # sum n ln(n / (r c)); the total is added once the pair's size is known.
            F.sum(n * F.ln(n / (r * c))).alias("logs"),
        )
    )
    names = local_frame(
        cells.sparkSession,
        [(i, *label) for i, label in enumerate(labels)],
        "pair int, table_name string, col_a string, col_b string",
    )
    total = F.col("total").cast("double")
    chi2 = F.greatest(total * (F.col("ratio") - 1), F.lit(0.0))
    dof = (F.col("n_a") - 1) * (F.col("n_b") - 1)
    least = F.least(F.col("n_a"), F.col("n_b")) - 1
    return (
        names.join(sums, "pair")
        .join(shape, "pair")
        .select(
            "table_name",
            "col_a",
            "col_b",
            F.col("total").alias("n"),
            chi2.alias("chi_square"),
            dof.alias("dof"),
            chi_square_p(chi2, dof).alias("p_value"),
            F.coalesce(F.sqrt(F.try_divide(chi2, total * least)), F.lit(0.0)).alias("cramers_v"),
            F.greatest(F.col("logs") / total + F.ln(total), F.lit(0.0)).alias("mutual_information"),
        )
    )


def column_entropy(tables: dict[str, DataFrame]) -> DataFrame:
    """Entropy of each text column in nats: ``ln N - sum(n ln n) / N``."""
    parts = []
    for table, df in tables.items():
        names = names_of(df, TEXT)
        if not names:
            continue
        n = F.col("n").cast("double")
        entropy = F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)
        parts.append(
            frequencies(df, names)
            .groupBy("column_name")
            .agg(F.greatest(entropy, F.lit(0.0)).alias("entropy"), F.count(F.lit(1)).alias("distinct_count"))
            .select(F.lit(table).alias("table_name"), "column_name", "distinct_count", "entropy")
        )
    fields = "table_name string, column_name string, distinct_count bigint, entropy double"
    return union_all(parts, tables, fields)
