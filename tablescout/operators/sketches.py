"""Mergeable quantile sketches, merged in a tree.

A task sketches what it reads; the sketches of ``FAN`` tasks meet in one group, ``FAN`` of those
in the next, and so on. No task merges more than that, however many tasks a scan has.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_K = 16_384  # about 400 KB a sketch
FAN = 64
ROWS_PER_TASK = 100_000  # least rows that a task is taken to read, to tell how high the tree is


def rank_error(k: int = SKETCH_K) -> float:
    """Share of rows by which a rank read from a sketch is off, in 99 of 100 cases at most.

    The constants are those that the sketch's public description states.
    """
    return 2.296 / k**0.9021


def tree_levels(rows: int, fan: int = FAN, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Levels of merging between the tasks that read ``rows`` and the root, which merges too."""
    tasks = max(1, ceil(rows / rows_per_task))
    return max(0, ceil(log(tasks) / log(fan) - 1e-9) - 1)


def merged(
    df: DataFrame,
    values: dict[str, str],
    sums: dict[str, str],
    rows: int,
    keys: list[str] | None = None,
    k: int = SKETCH_K,
    fan: int = FAN,
    levels: int | None = None,
) -> DataFrame:
    """One row per ``keys``: a sketch for each of ``values`` and a total for each of ``sums``.

    Both map result names to SQL text: a double, and an aggregate whose totals add up.
    """
    keys = keys or []
    levels = tree_levels(rows, fan) if levels is None else levels
    sketches = [F.expr(f"kll_sketch_agg_double({v}, {k})").alias(name) for name, v in values.items()]
    totals = [F.expr(total).alias(name) for name, total in sums.items()]
    if not levels:
        return df.groupBy(*keys).agg(*sketches, *totals)
    # The tree's leaves are groups of tasks, so that a task's rows are combined before they move.
    out = (
        df.withColumn("_node", F.expr(f"spark_partition_id() div {fan}"))
        .groupBy(*keys, "_node")
        .agg(*sketches, *totals)
    )
    unite = [F.expr(f"kll_merge_agg_double({name}, {k})").alias(name) for name in values]
    unite += [F.sum(name).alias(name) for name in sums]
    for _ in range(levels - 1):
        out = out.withColumn("_node", F.expr(f"_node div {fan}")).groupBy(*keys, "_node").agg(*unite)
    return out.groupBy(*keys).agg(*unite)


def quantiles_sql(sketch: str, count: str, points: list[float] | str) -> str:
    """SQL text of the values at the ranks ``points``, NULL for a sketch of nothing."""
    if not isinstance(points, str):
        points = f"array({', '.join(f'{p!r}D' for p in points)})"
    return f"if({count} > 0, kll_sketch_get_quantile_double({sketch}, {points}), NULL)"
