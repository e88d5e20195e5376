"""Running totals over an ordered column without putting the column into one task.

Values are cut into ranges by a quantile sketch. Each range is totalled and ordered by a task
of its own; the totals of the earlier ranges, a short table, are added to it. The range edges
are brought to the driver once (a fixed number of doubles) so that every stage, also a retried
one, cuts the data at the same places.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.sqltext import local_frame
from tablescout.functions.types import col

ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 4096


def range_edges(
    df: DataFrame,
    value: str,
    rows_per_range: int = ROWS_PER_RANGE,
    row_count: int | None = None,
) -> list[float]:
    """Sorted distinct inner edges; empty when one range is enough."""
    row_count = df.count() if row_count is None else row_count
    ranges = min(MAX_RANGES, ceil(row_count / rows_per_range))
    if ranges <= 1:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    edges = df.agg(F.percentile_approx(col(value).cast("double"), shares, 10 * ranges)).first()[0]
    return sorted(set(edges or []))


def cumulative(
    df: DataFrame,
    value: str,
    *measures: str,
    rows: DataFrame | None = None,
    row_count: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``after`` (or ``after_<measure>``): the measure summed up to and including the row.

    ``df`` holds one row per distinct ``value``. The ranges are cut from ``rows``, the values
    before they were grouped, so that finding the edges needs no shuffle; ``row_count`` is
    their number or a bound on it, if known.
    """
    names = {m: "after" if len(measures) == 1 else f"after_{m}" for m in measures}
    edges = range_edges(df if rows is None else rows, value, rows_per_range, row_count)
    if not edges:
        order = W.orderBy(col(value)).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(m).over(order) for m, out in names.items()})
    # Two levels of edges keep the search short: first the block, then the edge in the block.
    size = ceil(len(edges) ** 0.5)
    blocks = [edges[i : i + size] for i in range(0, len(edges), size)]
    spark = df.sparkSession
    search = local_frame(
        spark,
        [([b[0] for b in blocks], blocks)], "firsts array<double>, blocks array<array<double>>"
    ).select(F.struct("firsts", "blocks")).scalar()
    v = col(value).cast("double")
    with_edges = df.withColumn("_search", search)
    block = F.size(F.filter("_search.firsts", lambda e: e <= v))
    inner = F.size(F.filter(F.get(F.col("_search.blocks"), F.col("_block") - 1), lambda e: e <= v))
    located = (
        with_edges.withColumn("_block", block)
        .withColumn(
            "_range", F.when(F.col("_block") == 0, 0).otherwise((F.col("_block") - 1) * size + inner)
        )
        .drop("_search", "_block")
    )
    sums = [F.sum(m).alias(f"_t_{m}") for m in measures]
    # At most MAX_RANGES rows: ordering them in one task and broadcasting them is bounded.
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        located.groupBy("_range")
        .agg(*sums)
        .select(
            "_range", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
        )
    )
    within = W.partitionBy("_range").orderBy(col(value)).rowsBetween(W.unboundedPreceding, 0)
    totalled = located.withColumns({f"_w_{m}": F.sum(m).over(within) for m in measures})
    return totalled.join(F.broadcast(offsets), "_range").select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_w_{m}") + F.col(f"_o_{m}")).alias(out) for m, out in names.items()],
    )
