"""Columns as few cells: association of columns of any type, drift between any two windows.

Numbers are cut at their exact deciles, texts of few values and booleans are their own cells, so
every table of counts here is bounded by the schema (and the calendar), whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.sqltext import ident
from tablescout.functions.types import BOOLEAN, NUMERIC, TEXT, col, names_of, nan_to_null, union_all
from tablescout.operators.associate import table_associations
from tablescout.operators.frequency import distinct_up_to
from tablescout.operators.quantiles import column_quantiles
from tablescout.operators.trends import as_time, period_of

CELLS = 10
MOST_VALUES = 100


def few_valued(df: DataFrame, most: int = MOST_VALUES) -> list[str]:
    """Text columns of 2 to ``most`` values."""
    counts = distinct_up_to(df, names_of(df, TEXT), most)
    return [c for c, n in counts.items() if n is not None and n > 1]


def cell_edges(
    tables: dict[str, DataFrame], cells: int = CELLS
) -> dict[tuple[str, str], list[float]]:
    """Per numeric column the distinct quantiles that cut it into ``cells``, of 12 digits.

    A value that fills several cells leaves fewer edges. Schema-sized, so kept on the driver: all
    later jobs cut at the same places.
    """
    shares = {f"q{k}": k / cells for k in range(1, cells)}
    return {
        (r["table_name"], r["column_name"]): sorted({float(f"{r[q]:.12g}") for q in shares if r[q] is not None})
        for r in column_quantiles(tables, shares).collect()
    }


def cell_of(name: str, edges: list[float]) -> Column:
    """How many edges a number has reached, as text; NULL for NULL."""
    value = f"CAST({ident(name)} AS DOUBLE)"
    reached = " + ".join(["0", *[f"CAST({value} >= CAST('{e!r}' AS DOUBLE) AS INT)" for e in edges]])
    return F.expr(f"CASE WHEN {value} IS NOT NULL THEN CAST({reached} AS STRING) END").alias(name)


def coded(df: DataFrame, edges: dict[str, list[float]], texts: list[str]) -> DataFrame:
    """Numeric columns as cells, booleans and the given text columns as they are; all as text."""
    numbers = [cell_of(c, edges.get(c, [])) for c in names_of(df, NUMERIC)]
    rest = [col(c).cast("string").alias(c) for c in [*names_of(df, BOOLEAN), *texts]]
    return nan_to_null(df).select(*numbers, *rest)


def mixed_associations(
    tables: dict[str, DataFrame], cells: int = CELLS, most_values: int = MOST_VALUES
) -> DataFrame:
    """Mutual information, Cramér's V and chi-square of all pairs of numeric, boolean and few-valued
    text columns of each table.

    A pair has at most ``max(cells, most_values)`` squared cells, combined before the shuffle. Only
    rows where both columns are present count; a pair without any has no row.
    """
    edges = cell_edges(tables, cells)
    return table_associations(
        {
            table: coded(df, {c: e for (t, c), e in edges.items() if t == table}, few_valued(df, most_values))
            for table, df in tables.items()
        }
    )


def period_counts(
    df: DataFrame, time: str, granularity: str, cells: int = CELLS, most_values: int = MOST_VALUES
) -> DataFrame:
    """``(column_name, period, cell, n, after)`` of every numeric, boolean and few-valued text column.

    ``after`` is the running count of a cell up to and including the period, so any window is a
    difference of two rows; written once, the table answers all windows without another scan.
    Rows without a time or value are left out.
    """
    own = {c: e for (_, c), e in cell_edges({"t": df}, cells).items()}
    few = [c for c in few_valued(df, most_values) if c != time]
    spread = coded(df.withColumn("_period", period_of(as_time(df, time), granularity)), own, [*few, "_period"])
    names = [c for c in spread.columns if c not in (time, "_period")]
    rows = [F.struct(F.lit(c).alias("column_name"), col(c).alias("cell")) for c in names]
    if not rows:
        return union_all([], {"t": df}, "column_name string, period timestamp_ntz, cell string, n bigint, after bigint")
    counts = (
        spread.select(F.col("_period").cast("timestamp_ntz").alias("period"), F.inline(F.array(*rows)))
        .where("period IS NOT NULL AND cell IS NOT NULL")
        .groupBy("column_name", "period", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one row per period in each partition of the window.
    upto = W.partitionBy("column_name", "cell").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("after", F.sum("n").over(upto))


def window_drift(counts: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Total variation between two windows ``[from, to)`` of each column of ``period_counts``.

    NULL where a window holds no value of the column. A period belongs where it starts.
    """

    def until(moment: str) -> Column:
        earlier = F.col("period") < F.lit(moment).cast("timestamp_ntz")
        return F.coalesce(F.max(F.when(earlier, F.col("after"))), F.lit(0))

    held = counts.groupBy("column_name", "cell").agg(
        *[(until(w[1]) - until(w[0])).alias(name) for w, name in ((first, "n1"), (second, "n2"))]
    )
    return _variation(held, "column_name")


def _variation(held: DataFrame, *keys: str) -> DataFrame:
    """Half the summed differences of the shares ``n1`` and ``n2`` within each of ``keys``."""
    whole = W.partitionBy(*keys)
    shares = held.withColumns({"t1": F.sum("n1").over(whole), "t2": F.sum("n2").over(whole)})
    gap = F.abs(F.try_divide("n1", "t1") - F.try_divide("n2", "t2"))
    return shares.groupBy(*keys).agg(
        F.max("t1").alias("n_first"),
        F.max("t2").alias("n_second"),
        (F.sum(gap) / 2).alias("total_variation"),
    )


def largest_change(counts: DataFrame, span: int) -> DataFrame:
    """The period of each column before and from which ``span`` periods differ most.

    Periods are those in which the column has values. Of equal changes (to 9 digits) the earliest
    counts; a column of fewer than ``2 * span`` periods has no row.
    """
    periods = counts.select("column_name", "period").distinct()
    in_order = W.partitionBy("column_name").orderBy("period")
    numbered = periods.withColumns(
        {"k": F.row_number().over(in_order), "periods": F.count(F.lit(1)).over(W.partitionBy("column_name"))}
    )
    grid = numbered.join(counts.select("column_name", "cell").distinct(), "column_name")
    dense = grid.join(counts.drop("after"), ["column_name", "period", "cell"], "left").fillna(0, ["n"])
    along = W.partitionBy("column_name", "cell").orderBy("period")
    held = dense.withColumns(
        {
            "n1": F.sum("n").over(along.rowsBetween(-span, -1)),
            "n2": F.sum("n").over(along.rowsBetween(0, span - 1)),
        }
    ).where((F.col("k") > span) & (F.col("k") + span - 1 <= F.col("periods")))
    moved = _variation(held, "column_name", "period").withColumn("change", F.round("total_variation", 9))
    best = F.min(F.struct((-F.col("change")).alias("less"), F.col("period")))
    return moved.groupBy("column_name").agg(best.alias("b")).select(
        "column_name", F.col("b.period").alias("change_period"), (-F.col("b.less")).alias("change")
    )
