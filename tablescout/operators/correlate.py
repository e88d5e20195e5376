"""Pearson and Spearman correlations in long form: ``table_name, method, col_a, col_b, r``."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.local import at_once, settle, work_folder
from tablescout.functions.sqltext import ident, inline_rows, local_frame
from tablescout.functions.tails import student_two_sided
from tablescout.functions.types import NUMERIC, col, names_of, nan_to_null, union_all
from tablescout.operators.ranges import (
    CELLS, COUNTS, PRODUCTS, RANKED, cells, products, ranked, rows_of, slot_counts,
)
from tablescout.operators.sketches import ROWS_PER_TASK, merged, quantiles_sql

_CORRELATION = (
    "table_name string, method string, col_a string, col_b string, r double, n bigint"
)

HOT_EDGES = 1024  # a value that fills more than this part of a column is ranked by counting
PERFECT = 2e-6  # of 1 - r^2: below it a correlation counts as perfect


def _pair_matrix(
    df: DataFrame,
    table: str,
    pairs: list[tuple[str, str]],
    method: str,
) -> DataFrame:
    """All pairs in one scan: rows are unpivoted to complete pairs and their moments grouped.

    There are as many groups as column pairs, combined before the shuffle. One short grouped
    aggregate runs several times faster than one aggregate list as wide as the pair list.
    """
    rows = [{"i": str(i), "a": ident(a), "b": ident(b)} for i, (a, b) in enumerate(pairs)]
    moments = (
        df.select(inline_rows(rows))
        .where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("i")
        .agg(
            F.covar_pop("a", "b").alias("covariance"),
            (F.stddev_pop("a") * F.stddev_pop("b")).alias("spread"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return _correlated(moments, table, pairs, method)


def _correlated(moments: DataFrame, table: str, pairs: list[tuple[str, str]], method: str) -> DataFrame:
    """Correlations of the pairs, numbered ``i`` in ``moments``: ``i, covariance, spread, n``."""
    labels = local_frame(
        moments.sparkSession,
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, col_a string, col_b string"
    )
    # ``corr`` fails on a constant column in ANSI mode; here an undefined correlation is 0.
    # So is one that an infinite value leaves without a number.
    ratio = F.try_divide(F.col("covariance"), F.col("spread"))
    r = F.coalesce(F.nanvl(ratio, F.lit(None).cast("double")), F.lit(0.0))
    return labels.join(moments, "i", "left").select(
        F.lit(table).alias("table_name"),
        F.lit(method).alias("method"),
        "col_a",
        "col_b",
        r.alias("r"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _doubles(df: DataFrame) -> DataFrame:
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in map(ident, names_of(df, NUMERIC))]
    return nan_to_null(df).selectExpr(*casts)


def pearson(tables: dict[str, DataFrame]) -> DataFrame:
    """Each unordered pair of numeric columns once, with the number of complete rows ``n``."""
    parts = []
    for table, df in tables.items():
        pairs = list(combinations(sorted(names_of(df, NUMERIC)), 2))
        if pairs:
            parts.append(_pair_matrix(_doubles(df), table, pairs, "pearson"))
    return union_all(parts, tables, _CORRELATION)


def _hot_values(values: DataFrame, names: list[str], rows: int) -> list[list[float]]:
    """Per column, the values that cut it into ``HOT_EDGES`` parts; so all that fill one are there.

    Tables that one task reads are not cut: there a value cannot fill more than one task.
    """
    if rows <= ROWS_PER_TASK:
        return [[] for _ in names]
    places = [g / HOT_EDGES for g in range(HOT_EDGES + 1)]
    sketches = {f"s{i}": ident(c) for i, c in enumerate(names)}
    counts = {f"n{i}": f"count({ident(c)})" for i, c in enumerate(names)}
    wide = merged(values, sketches, counts, rows)
    found = wide.select(
        *[F.expr(quantiles_sql(f"s{i}", f"n{i}", places)).alias(f"q{i}") for i in range(len(names))]
    ).first()
    return [sorted(set(q or [])) for q in found]


def _ranked_cells(
    values: DataFrame, lists: list[tuple[str, str]], hot: list[list[float]], folder: str
) -> DataFrame:
    """The average ranks of the rows' values in each list, as ``RANKED``.

    A list is a column and a condition on the rows that count, ``hot`` the sorted edges that cut
    it. Values at an edge are ranked by counts alone. The others are dealt by (list, range), ranked
    there, and then put together in blocks of rows: the two shuffles, in which the numbers of a
    block and range travel as one row. A range holds as many rows as lie between two edges; the
    counts tell how many rows come before it. The lists are written to ``folder`` first, so that
    all passes see the same rows in the same order.
    """
    listed = [f"if({condition}, {ident(c)} + 0.0D, NULL) AS l{i}" for i, (c, condition) in enumerate(lists)]
    stored = settle(values.selectExpr(*listed), folder, "lists")
    counts = [{} for _ in lists]
    if any(hot):
        # At most two rows per edge reach the driver.
        counted = stored.mapInArrow(slot_counts(hot), COUNTS).groupBy("i", "slot").agg(F.sum("n").alias("n"))
        for r in counted.collect():
            counts[r["i"]][r["slot"]] = r["n"]
    numbered = stored.select(F.monotonically_increasing_id().alias("_row"), "*")
    dealt = numbered.mapInArrow(cells(hot, counts), CELLS)
    return dealt.groupBy("i", "below").applyInArrow(ranked, RANKED)


def ranks(
    values: DataFrame, lists: list[tuple[str, str]], hot: list[list[float]], folder: str
) -> DataFrame:
    """``_row`` and, per list, the average rank of the row's value in it: ``r0, r1, ...``."""
    placed = _ranked_cells(values, lists, hot, folder)
    schema = ", ".join(["_row bigint", *[f"r{i} double" for i in range(len(lists))]])
    return placed.groupBy("_row").applyInArrow(rows_of(len(lists)), schema)


def _lists(
    values: DataFrame, names: list[str], sizes: list[int]
) -> tuple[list[tuple[str, str]], list[tuple[int, int]], list[int]]:
    """The lists to rank, the two lists of each pair of ``names``, and the rows of each list.

    A pair with missing values is ranked over its complete rows; a column whose partner misses
    none shares its ranks with the other such pairs.
    """
    some = {c for c, n in zip(names, sizes[1:]) if n < sizes[0]}
    place, held = {}, []
    for a, b in combinations(names, 2):
        sides = [(x, f"{ident(y)} IS NOT NULL" if y in some else "true") for x, y in ((a, b), (b, a))]
        # Without the rows that the other column misses, each side has the same rows.
        sides = [(x, f"{ident(x)} IS NOT NULL AND {c}" if x in some else c) for x, c in sides]
        held.append(tuple(place.setdefault(side, len(place)) for side in sides))
    lists = list(place)
    if not some:
        return lists, held, [sizes[0]] * len(lists)
    counted = values.agg(*[F.count_if(F.expr(c)) for _, c in lists]).first()
    return lists, held, list(counted)


def _rank_matrix(table: str, values: DataFrame, sizes: list[int]) -> DataFrame:
    names = values.columns
    lists, held, rows = _lists(values, names, sizes)
    hot = dict(zip(names, _hot_values(values, names, sizes[0])))
    placed = _ranked_cells(values, lists, [hot[c] for c, _ in lists], work_folder(values.sparkSession))
    # The mean rank follows from the number of rows, so a block of rows is summed as it is put together.
    sums = placed.groupBy("_row").applyInArrow(products(held, [(n + 1) / 2 for n in rows]), PRODUCTS)
    moments = sums.groupBy("i").agg(
        F.sum("xy").alias("covariance"),
        (F.sqrt(F.sum("xx")) * F.sqrt(F.sum("yy"))).alias("spread"),
        F.sum("n").alias("n"),
    )
    return _correlated(moments, table, list(combinations(names, 2)), "spearman")


def spearman(tables: dict[str, DataFrame]) -> DataFrame:
    """Pearson on average ranks, re-ranked over the complete rows of a pair if values miss."""
    found = {t: sorted(names_of(df, NUMERIC)) for t, df in tables.items()}
    values = {t: _doubles(tables[t]).select(*map(col, c)) for t, c in found.items() if len(c) > 1}
    if not values:
        return union_all([], tables, _CORRELATION)
    # One row per table: its rows and those of each column.
    sizes = union_all(
        [
            v.agg(F.array(F.count(F.lit(1)), *[F.count(col(c)) for c in v.columns]).alias("n"))
            .select(F.lit(t).alias("table_name"), "n")
            for t, v in values.items()
        ]
    ).collect()
    return union_all(at_once(lambda r: _rank_matrix(r["table_name"], values[r["table_name"]], r["n"]), sizes))


def strong_pairs(correlations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs at or above the threshold in absolute value."""
    return correlations.where(F.abs("r") >= threshold)


def both_directions(correlations: DataFrame) -> DataFrame:
    """The symmetric matrix without its diagonal, from the pairs listed once."""
    swap = F.array(
        F.struct(F.col("col_a").alias("a"), F.col("col_b").alias("b")),
        F.struct(F.col("col_b").alias("a"), F.col("col_a").alias("b")),
    )
    others = [c for c in correlations.columns if c not in ("col_a", "col_b")]
    return correlations.select(*others, F.inline(swap)).withColumnsRenamed(
        {"a": "col_a", "b": "col_b"}
    )


def column_correlates(correlations: DataFrame, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """For each column, its strongest partners within the table. One row per column pair."""
    order = W.partitionBy("table_name", "method", "col_a").orderBy(F.desc(F.abs("r")), "col_b")
    return (
        both_directions(correlations)
        .where(F.abs("r") >= threshold)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
    )


def heatmap(correlations: DataFrame, columns: list[str]) -> DataFrame:
    """Wide matrix over ``columns``, with 1 on the diagonal."""
    pairs = both_directions(correlations).select("col_a", "col_b", "r")
    diagonal = local_frame(
        correlations.sparkSession,
        [(c, c, 1.0) for c in columns], "col_a string, col_b string, r double"
    )
    return pairs.unionByName(diagonal).groupBy("col_a").pivot("col_b", columns).agg(F.first("r"))


def correlation_t(correlations: DataFrame) -> DataFrame:
    """Test statistic of each correlation, ``t = r sqrt((n - 2) / (1 - r^2))``, and its p-value.

    They are undefined, and missing, where the correlation is perfect but for rounding, and for
    fewer than three rows.
    """
    rest = 1 - F.col("r") * F.col("r")
    ratio = F.try_divide(F.col("n") - 2, F.when(rest > PERFECT, rest))
    t = F.when(ratio >= 0, F.col("r") * F.sqrt(F.greatest(ratio, F.lit(0.0))))
    with_t = correlations.withColumn("t", t)
    return with_t.withColumn("p_value", student_two_sided(F.col("t"), F.col("n") - 2))
