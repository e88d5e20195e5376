"""Overlap of columns from set sketches: an approximate mode of the relationships between tables.

Every column becomes one theta sketch of bounded size. Sketches are a table of their own, to be
written as Parquet once per source; any two sources are then compared from their sketches, and no
value is read or shuffled again. The exact mode is ``tablescout.operators.relate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.sqltext import inline_rows, literal
from tablescout.functions.types import family, nan_to_null, union_all
from tablescout.operators.frequency import COUNTABLE, KEYS
from tablescout.operators.relate import shared_key
from tablescout.operators.sketches import FAN, tree_levels

BITS = 12  # 2 ** BITS hashes in a sketch, 32 to 64 KB
SKETCHES = "table_name string, ordinal int, column_name string, family string, sketch binary"


def column_sketches(
    tables: dict[str, DataFrame], bits: int = BITS, fan: int = FAN, levels: int | None = None
) -> DataFrame:
    """``(table_name, ordinal, column_name, family, sketch)`` of every comparable column.

    Values are hashed by the same keys as in the exact mode, so numbers meet across types; the
    64-bit hash makes values equal that are not once in about 10^19 pairs. Missing values and NaN
    are in no set; the sketch of a column without values is that of the empty set. A task sketches
    what it reads, then at most ``fan`` sketches of a column meet in a group, level by level.
    """
    parts, sizes = [], []
    for table, df in tables.items():
        aggregates, rows = [], []
        for i, field in enumerate(df.schema.fields):
            if family(field.dataType) not in COUNTABLE:
                continue
            key = shared_key(field)
            absent = " AND ".join(f"{key[k]} IS NULL" for k in KEYS)
            # Which slot holds the value is part of the hash: bits of one type may be another's.
            slots = f"{key['float_key']} IS NULL, " + ", ".join(key[k] for k in KEYS)
            value = f"if({absent}, CAST(NULL AS BIGINT), xxhash64({slots}))"
            aggregates.append(F.expr(f"theta_sketch_agg({value}, {bits})").alias(f"_s{i}"))
            rows.append(
                {
                    "table_name": literal(table),
                    "ordinal": str(i),
                    "column_name": literal(field.name),
                    "family": literal(family(field.dataType)),
                    "sketch": f"_s{i}",
                }
            )
        if not rows:
            continue
        node = F.expr(f"spark_partition_id() div {fan}").alias("_node")
        leaves = nan_to_null(df).groupBy(node).agg(*aggregates)
        parts.append(leaves.select("_node", inline_rows(rows)))
        sizes.append(df.agg(F.count(F.lit(1)).alias("n")))
    names = ["table_name", "ordinal", "column_name", "family"]
    if not parts:
        return union_all([], tables, SKETCHES)
    if levels is None:
        # Counts of rows, one for each table, tell how high the tree is.
        levels = tree_levels(max(r["n"] for r in union_all(sizes).collect()), fan)
    unite = F.expr(f"theta_union_agg(sketch, {bits})").alias("sketch")
    out = union_all(parts)
    for _ in range(levels - 1):
        out = out.withColumn("_node", F.expr(f"_node div {fan}")).groupBy(*names, "_node").agg(unite)
    return out.groupBy(*names).agg(unite)


def _error(overlap: Column, larger: Column, bits: int, deviations: float) -> Column:
    """Bound on the error of an estimated overlap: a binomial sample of the common values.

    Two sketches share the hashes below the smaller of their thresholds, about ``2 ** bits`` of
    the ``larger`` set's values; nothing is estimated where both sets are within their sketches.
    """
    values_per_hash = larger / (1 << bits)
    bound = deviations * F.sqrt((overlap + deviations**2 * values_per_hash) * values_per_hash)
    return F.when(values_per_hash <= 1, F.lit(0).cast("bigint")).otherwise(F.ceil(bound))


def approx_overlaps(
    first: DataFrame, second: DataFrame, bits: int = BITS, deviations: float = 4.0
) -> DataFrame:
    """Estimated overlap of every column in ``first`` with every one of its family in ``second``.

    Both are sketch tables of ``column_sketches``. ``overlap_error`` bounds the error of
    ``overlap_count`` with as many standard deviations as given; it is 0, and the counts are
    exact, where both columns have at most ``2 ** bits`` distinct values.
    """
    named = []
    for side, sketches in (("source", first), ("target", second)):
        named.append(
            sketches.select(
                "family",
                F.col("table_name").alias(f"{side}_table"),
                F.col("column_name").alias(f"{side}_column"),
                F.col("sketch").alias(f"{side}_sketch"),
                F.theta_sketch_estimate("sketch").alias(f"{side}_unique"),
            )
        )
    common = F.theta_sketch_estimate(F.theta_intersection("source_sketch", "target_sketch"))
    larger = F.greatest("source_unique", "target_unique")
    rate = F.try_divide("overlap_count", "source_unique")
    # One sketch per column on either side: the planner broadcasts by size.
    return (
        named[0]
        .join(named[1], "family")
        .withColumn("overlap_count", common)
        .select(
            "source_table",
            "source_column",
            "target_table",
            "target_column",
            "source_unique",
            "target_unique",
            "overlap_count",
            _error(F.col("overlap_count"), larger, bits, deviations).alias("overlap_error"),
            F.least(F.coalesce(rate, F.lit(0.0)), F.lit(1.0)).alias("match_rate"),
        )
    )
