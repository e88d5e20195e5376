"""Exact quantiles without sorting the data.

The first scan sketches every column; sketches are merged in a tree. It gives, for every wanted
probability, a narrow bracket of values that holds the wanted ranks. While a bracket may still
hold more than ``BRACKET_ROWS`` rows, a scan counts what lies below it and sketches only what
lies inside, which narrows it by the same factor again. The last scan counts values: inside a
bracket per value, between brackets as one number. What is left to order is a number of rows
that does not grow with the data; no task ever holds or sorts a column.

The scans run when the operator is called, because the edges of one are constants of the next,
and a missed rank is looked for again in wider brackets; each brings one row per numeric column
and probability to the driver.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.sqltext import ident, inline_rows, label_of, literal, local_frame
from tablescout.functions.types import NUMERIC, names_of, nan_to_null, union_all
from tablescout.operators.sketches import FAN, SKETCH_K, merged, quantiles_sql, rank_error

BRACKET_ROWS = 1_000_000
GRID = 1000  # places at which the sketch of a bracket's rows is read

Spans = dict[tuple[str, str], list[tuple[float, float]]]


def largest_table(tables: dict[str, DataFrame]) -> int:
    """Rows of the largest table; counting them reads no column."""
    counts = union_all([df.agg(F.count(F.lit(1)).alias("n")) for df in tables.values()])
    return counts.agg(F.max("n")).first()[0]


def _doubles(df: DataFrame) -> DataFrame:
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in map(ident, names_of(df, NUMERIC))]
    return nan_to_null(df).selectExpr(*casts)


def _sketched(tables: dict[str, DataFrame], points: list[float], rows: int, k: int, fan: int):
    """Per numeric column: its extremes, count, and the sketch's values at ``points``; one job."""
    parts = []
    for table, df in tables.items():
        names = names_of(df, NUMERIC)
        values = {f"s_{i}": ident(c) for i, c in enumerate(names)}
        sums = {f"n_{i}": f"count({ident(c)})" for i, c in enumerate(names)}
        wide = merged(_doubles(df), values, sums, rows, k=k, fan=fan)
        # The first and last values that a sketch knows are the exact extremes.
        facts = [
            {
                "column_name": literal(c),
                "edges": quantiles_sql(f"s_{i}", f"n_{i}", [0.0, *points, 1.0]),
                "n": f"n_{i}",
            }
            for i, c in enumerate(names)
        ]
        parts.append(wide.select(F.lit(table).alias("table_name"), inline_rows(facts)))
    return union_all(parts)


def _ranks(n: int, p: float) -> tuple[int, int]:
    """The ranks, from 0, between which the quantile of ``p`` lies."""
    position = (n - 1) * p
    return floor(position), ceil(position)


def _brackets(
    tables: dict[str, DataFrame],
    probabilities: list[float],
    rows: int,
    k: int,
    widen: float,
    bracket_rows: int,
    fan: int,
) -> Spans:
    """Disjoint sorted value intervals per column that hold every wanted rank."""
    margin = min(1.0, widen * 2 * rank_error(k))
    lows = [max(p - margin, 0.0) for p in probabilities]
    highs = [min(p + margin, 1.0) for p in probabilities]
    spans: Spans = {}
    counts: dict[tuple[str, str], int] = {}
    for r in _sketched(tables, lows + highs, rows, k, fan).where("n > 0").collect():
        low, *edges, high = r["edges"]
        counts[_key(r)] = r["n"]
        half = len(probabilities)
        # A sketch of at most half its size has forgotten nothing; its column is counted whole.
        spans[_key(r)] = [
            (low, high)
            if r["n"] <= k // 2
            else (
                low if lows[j] == 0.0 else edges[j],
                high if highs[j] == 1.0 else edges[half + j],
            )
            for j in range(half)
        ]
    inside = 2 * margin * max(counts.values(), default=0)
    while inside > bracket_rows:
        before = inside
        spans, inside = _narrowed(tables, spans, counts, probabilities, rows, k, margin, fan)
        if inside > 0.9 * before:
            break
    return {key: _disjoint(found) for key, found in spans.items()}


def _disjoint(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _narrowed(
    tables: dict[str, DataFrame],
    spans: Spans,
    counts: dict[tuple[str, str], int],
    probabilities: list[float],
    rows: int,
    k: int,
    margin: float,
    fan: int,
) -> tuple[Spans, float]:
    """Narrower spans of each column and probability, and about how many rows they may hold.

    The rows at a span's ends are counted, only those between them sketched: a value that fills
    most of a column is an end, and costs nothing from then on.
    """
    parts, names_by_table = [], {}
    for table, df in tables.items():
        names = [c for c in names_of(df, NUMERIC) if (table, c) in spans]
        if not names:
            continue
        names_by_table[table] = names
        edges = []
        for i, c in enumerate(names):
            for j, (low, high) in enumerate(spans[table, c]):
                edges.append((i, j, low, high, *_ranks(counts[table, c], probabilities[j])))
        kind = "i int, j int, low double, high double, first bigint, last bigint"
        wanted = local_frame(df.sparkSession, edges, kind)
        values = _doubles(df).select(
            inline_rows([{"i": str(i), "v": ident(c)} for i, c in enumerate(names)])
        )
        # One row per numeric column and probability: broadcasting them is bounded by the schema.
        met = values.where("v IS NOT NULL").join(F.broadcast(wanted), "i")
        counted = met.groupBy("i", "j").agg(
            F.count_if(F.expr("v <= low")).alias("upto"), F.count_if(F.expr("v < high")).alias("under")
        )
        between = met.where("low < v AND v < high")
        inner = merged(between, {"s": "v"}, {"n": "count(v)"}, rows, ["i", "j"], k, fan)
        # The sketch is asked at fixed places; the next ones around a wanted place are taken.
        places = quantiles_sql("s", "n", [g / GRID for g in range(GRID + 1)])
        place = f"greatest(0D, least(1D, ({{}} - upto) / n {{}} {margin!r}D)) * {GRID}"
        low = f"get(grid, CAST(floor({place.format('first', '-')}) AS INT))"
        high = f"get(grid, CAST(ceil({place.format('last', '+')}) AS INT))"
        parts.append(
            wanted.join(counted, ["i", "j"])
            .join(inner, ["i", "j"], "left")
            .withColumn("grid", F.expr(places))
            .select(
                F.lit(table).alias("table_name"), "*", F.expr(low).alias("e0"), F.expr(high).alias("e1")
            )
            .drop("s", "grid")
        )
    out: Spans = {key: list(found) for key, found in spans.items()}
    most = 0.0
    for r in union_all(parts).collect():
        if r["e0"] is None:
            continue
        key = (r["table_name"], names_by_table[r["table_name"]][r["i"]])
        out[key][r["j"]] = (
            r["low"] if r["first"] < r["upto"] else r["e0"],
            r["high"] if r["last"] >= r["under"] else r["e1"],
        )
        most = max(most, min(1.0, 2 * margin + 2 / GRID) * r["n"])
    return out, most


def _key(row) -> tuple[str, str]:
    return row["table_name"], row["column_name"]


def _cell(value: Column, k: int) -> list[Column]:
    """``(cell, between)``: the value itself inside a bracket, else the last edge below it."""
    spans = [(F.col(f"low_{j}"), F.col(f"high_{j}")) for j in range(k)]
    # Unused spans are NULL and match nothing.
    inside = F.coalesce(
        reduce(lambda a, b: a | b, [value.between(low, high) for low, high in spans]),
        F.lit(False),
    )
    last = F.lit(None).cast("double")
    for _, high in spans:
        last = F.when(value > high, high).otherwise(last)
    return [F.when(inside, value).otherwise(last).alias("cell"), (~inside).alias("between")]


def _bracket_counts(
    table: str, df: DataFrame, brackets: dict[tuple[str, str], list[tuple[float, float]]]
) -> DataFrame | None:
    """``(table_name, column_name, cell, between, n)``: enough to read off every wanted rank."""
    names = [c for c in names_of(df, NUMERIC) if (table, c) in brackets]
    if not names:
        return None
    k = max(len(brackets[table, c]) for c in names)
    rows = []
    for i, c in enumerate(names):
        spans = brackets[table, c]
        padded = spans + [(None, None)] * (k - len(spans))
        rows.append((i, *[edge for span in padded for edge in span]))
    fields = "".join(f", low_{j} double, high_{j} double" for j in range(k))
    edges = local_frame(df.sparkSession, rows, "i int" + fields)
    values = _doubles(df).select(
        inline_rows([{"i": str(i), "v": ident(c)} for i, c in enumerate(names)])
    )
    # The edges are one row per numeric column: broadcasting them is bounded by the schema.
    counts = (
        values.where("v IS NOT NULL")
        .join(F.broadcast(edges), "i")
        .select("i", *_cell(F.col("v"), k))
        .groupBy("i", "cell", "between")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        F.lit(table).alias("table_name"),
        label_of("i", names).alias("column_name"),
        "cell",
        "between",
        "n",
    )


def column_quantiles(
    tables: dict[str, DataFrame],
    probabilities: dict[str, float],
    exact: bool = True,
    k: int = SKETCH_K,
    bracket_rows: int = BRACKET_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Linearly interpolated quantiles of every numeric column, one output column per label.

    ``exact=False`` returns the sketch's own answers (elements, not interpolated) in one scan,
    within ``rank_error(k)`` of the wanted rank. ``k``, ``bracket_rows`` and ``fan`` change the
    work, not the exact answers.
    """
    labels, wanted = list(probabilities), list(probabilities.values())
    empty = union_all(
        [], tables, "table_name string, column_name string" + "".join(f", {x} double" for x in labels)
    )
    tables = {t: df for t, df in tables.items() if names_of(df, NUMERIC)}
    if not tables:
        return empty
    rows = largest_table(tables)
    if not exact:
        found = _sketched(tables, wanted, rows, k, fan)
        return found.select(
            "table_name",
            "column_name",
            *[F.get("edges", F.lit(j + 1)).alias(label) for j, label in enumerate(labels)],
        )

    # A sketch may miss a rank; the brackets of all columns are then widened, in the end to
    # whole columns. The answers are one row per column.
    widen = 1.0
    while True:
        picked = _picked(tables, probabilities, rows, k, widen, bracket_rows, fan)
        if picked is None:
            return empty
        found = picked.collect()
        if not any(r[label] is None for r in found for label in labels):
            return local_frame(picked.sparkSession, found, picked.schema)
        widen *= 8


def _picked(
    tables: dict[str, DataFrame],
    probabilities: dict[str, float],
    rows: int,
    k: int,
    widen: float,
    bracket_rows: int,
    fan: int,
) -> DataFrame | None:
    """Quantiles per column from the counts of one choice of brackets; NULL for a missed rank."""
    keys = ["table_name", "column_name"]
    brackets = _brackets(tables, list(probabilities.values()), rows, k, widen, bracket_rows, fan)
    counted = [_bracket_counts(t, df, brackets) for t, df in tables.items()]
    counted = [c for c in counted if c is not None]
    if not counted:
        return None
    counts = union_all(counted)
    # Only bracket contents reach this window: about ``bracket_rows`` rows per probability.
    ordered = W.partitionBy(*keys).orderBy(F.asc_nulls_first("cell"), "between")
    total = F.sum("n").over(W.partitionBy(*keys))
    ranked = counts.withColumns(
        {"after": F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, 0)), "total": total}
    ).withColumn("before", F.col("after") - F.col("n"))

    picks = [F.max("total").alias("total")]
    for label, p in probabilities.items():
        position = (F.col("total") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("before") <= rank) & (rank < F.col("after")) & ~F.col("between")
            picks.append(F.max(F.when(holds, F.col("cell"))).alias(f"{label}_{side}"))
    picked = ranked.groupBy(*keys).agg(*picks)

    out = []
    for label, p in probabilities.items():
        lo, hi = F.col(f"{label}_lo"), F.col(f"{label}_hi")
        position = (F.col("total") - 1) * F.lit(p)
        part = position - F.floor(position)
        # Between equal neighbours, or on a rank, there is nothing to interpolate: both may be
        # infinite.
        value = F.when((lo == hi) | (part == 0), lo).otherwise(lo + (hi - lo) * part)
        out.append(value.alias(label))
    return picked.select(*keys, *out)
