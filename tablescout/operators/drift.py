"""Comparing two samples of a column: Kolmogorov-Smirnov and total variation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.tails import kolmogorov_p
from tablescout.functions.types import DATETIME, NUMERIC, TEXT, col, names_of, nan_to_null, union_all
from tablescout.operators.ordering import cumulative


def ks_of(df: DataFrame, value: str, is_second: Column) -> DataFrame:
    """KS statistic, with its p-value, of the rows where ``is_second`` is false and those where true.

    Values are counted per sample, totalled in value order range by range, and compared.
    """
    clean = nan_to_null(df).select(col(value).cast("double").alias("v"), is_second.alias("second"))
    clean = clean.where("v IS NOT NULL AND second IS NOT NULL")
    counts = clean.groupBy("v").agg(
        F.count_if(~F.col("second")).alias("n1"), F.count_if("second").alias("n2")
    )
    totals = counts.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    # The running totals end at the sample sizes; one row carries both.
    sizes = totals.select(F.struct("t1", "t2").alias("t")).scalar()
    running = cumulative(counts, "v", "n1", "n2", rows=clean).withColumn("t", sizes)
    gap = F.abs(
        F.try_divide(F.col("after_n1"), F.col("t.t1")) - F.try_divide(F.col("after_n2"), F.col("t.t2"))
    )
    found = running.agg(
        F.max("t.t1").alias("n_first"), F.max("t.t2").alias("n_second"), F.max(gap).alias("ks")
    )
    p_value = kolmogorov_p(F.col("ks"), F.col("n_first"), F.col("n_second"))
    return found.withColumn("p_value", p_value)


def ks_statistic(first: DataFrame, a: str, second: DataFrame, b: str) -> DataFrame:
    """KS statistic between two columns."""
    left = first.select(col(a).cast("double").alias("v"), F.lit(False).alias("second"))
    right = second.select(col(b).cast("double").alias("v"), F.lit(True).alias("second"))
    return ks_of(left.unionByName(right), "v", F.col("second"))


def drift_numeric(df: DataFrame, recent: Column, columns: list[str] | None = None) -> DataFrame:
    """KS of each numeric column between the baseline and the ``recent`` rows."""
    names = columns if columns is not None else names_of(df, NUMERIC)
    return union_all(
        [
            ks_of(df, c, recent).select(F.lit(c).alias("column_name"), "n_first", "n_second", "ks", "p_value")
            for c in names
        ]
    )


def drift_categorical(df: DataFrame, recent: Column, columns: list[str] | None = None) -> DataFrame:
    """Total variation distance of each text column between baseline and ``recent`` rows."""
    names = columns if columns is not None else names_of(df, TEXT)
    labels = F.array(*[F.lit(c) for c in names])
    cells = [
        F.struct(F.lit(i).alias("i"), col(c).alias("key")) for i, c in enumerate(names)
    ]
    counts = (
        df.select(recent.alias("second"), F.inline(F.array(*cells)))
        .where("key IS NOT NULL AND second IS NOT NULL")
        .groupBy("i", "key")
        .agg(F.count_if(~F.col("second")).alias("n1"), F.count_if("second").alias("n2"))
    )
    totals = counts.groupBy("i").agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"))
    gap = F.abs(F.try_divide("n1", "t1") - F.try_divide("n2", "t2"))
    return (
        # One total per column of the table.
        counts.join(F.broadcast(totals), "i")
        .groupBy("i")
        .agg(
            F.max("t1").alias("n_first"),
            F.max("t2").alias("n_second"),
            (F.sum(gap) / 2).alias("total_variation"),
        )
        .select(F.get(labels, F.col("i")).alias("column_name"), "n_first", "n_second", "total_variation")
    )


def freshness(tables: dict[str, DataFrame], as_of: Column | None = None) -> DataFrame:
    """Age in days of the latest value of every time column."""
    as_of = F.current_date() if as_of is None else as_of
    parts = []
    for table, df in tables.items():
        names = names_of(df, DATETIME)
        if not names:
            continue
        wide = df.agg(*[F.max(col(c)).cast("timestamp_ntz").alias(f"t{i}") for i, c in enumerate(names)])
        rows = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"t{i}").alias("latest"))
            for i, c in enumerate(names)
        ]
        parts.append(
            wide.select(F.lit(table).alias("table_name"), F.inline(F.array(*rows))).withColumn(
                "age_days", F.datediff(as_of, "latest").cast("bigint")
            )
        )
    fields = "table_name string, column_name string, latest timestamp_ntz, age_days bigint"
    return union_all(parts, tables, fields)
