"""Sampling. Random choice hashes a key column, so a sample can be drawn again exactly."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.sqltext import local_frame
from tablescout.functions.types import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    OTHER,
    TEXT,
    col,
    family,
    is_fractional,
    is_integral,
    names_of,
    nan_to_null,
    union_all,
)
from tablescout.operators.frequency import frequencies
from tablescout.operators.profile import row_fingerprint
from tablescout.operators.quantiles import column_quantiles

HEX_DIGITS = 8
# Strata of an allocated sample, whose sizes reach the driver, and hex digits of their hash buckets.
MAX_STRATA = 10_000
BUCKET_DIGITS = 3


def _row(df: DataFrame) -> Column:
    """A number for a whole row, for rows without a key and as the tie-break of equal keys."""
    return F.xxhash64(*row_fingerprint(df))


def _order(df: DataFrame, key: str) -> Column:
    """Hash of the key; rows of a NULL key are drawn by their whole content instead."""
    return F.md5(F.coalesce(col(key).cast("string"), F.concat(F.lit("row "), _row(df))))


def _first(df: DataFrame, key: str, n: int, among: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes out of ``among``; all of them where there are fewer.

    Rows whose hash is far beyond the n-th are left out before the top-n, so that its last
    task receives little more than ``n`` rows however many tasks there are. The share holds for
    keys, not for rows: where repeated keys leave it short of ``n`` rows, it is widened.
    """
    percent = 100 * (n + 10 * n**0.5 + 20) / max(1, among)
    drawn = hashed_sample(df, key, min(100.0, percent))
    while percent < 100 and drawn.count() < min(n, among):
        percent *= 8
        drawn = hashed_sample(df, key, min(100.0, percent))
    return drawn.orderBy(_order(df, key), _row(df)).limit(n)


def sample_percent(rows: int, target: int) -> float:
    """Share of rows to draw in percent, between 0.1 and 100."""
    return 100.0 if rows == 0 else min(100.0, max(0.1, target / rows * 100))


def bernoulli_sample(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """Spark's own random sample: one narrow pass."""
    return df.sample(fraction=percent / 100, seed=seed)


def hashed_sample(df: DataFrame, key: str, percent: float) -> DataFrame:
    """Rows whose key hash falls below the share: narrow, repeatable, partition-independent."""
    limit = round(16**HEX_DIGITS * percent / 100)
    if limit >= 16**HEX_DIGITS:
        return df
    return df.where(F.substring(_order(df, key), 1, HEX_DIGITS) < f"{limit:0{HEX_DIGITS}x}")


def random_sample(df: DataFrame, key: str, target: int, rows: int | None = None) -> DataFrame:
    """About ``target`` rows and never more: hashed share, then a top-n by hash as the cap.

    Where repeated keys leave the share far short of ``target``, the rows of the next hashes
    fill it up. ``rows`` is the number of rows of ``df``, where it is known.
    """
    rows = df.count() if rows is None else rows
    percent = sample_percent(rows, target)
    if percent >= 100:
        return _first(df, key, target, rows)
    share = hashed_sample(df, key, percent)
    drawn = share.count()
    if drawn < max(1, target - 5 * target**0.5):  # below what chance leaves of unique keys
        return _first(df, key, target, rows)
    return _first(share, key, target, drawn)


def _outside(
    df: DataFrame, main: DataFrame, columns: list[str], low: float, high: float, key: str, cap: int
) -> list[DataFrame]:
    """Per column, up to ``cap`` rows of ``df`` beyond the two quantiles of ``main``."""
    if not columns or cap <= 0:
        return []
    edges = {
        r["column_name"]: (r["low"], r["high"])
        for r in column_quantiles(
            {"main": main.select(*[col(c) for c in columns])}, {"low": low, "high": high}
        ).collect()
    }
    tests = {}
    for c in columns:
        if c not in edges:
            continue
        below, above = edges[c]
        if is_integral(df.schema[c].dataType):
            # Whole numbers on both sides, so that the comparison is pushed into the scan.
            below, above = ceil(below), floor(above)
        beyond = (col(c) < below) | (col(c) > above)
        if is_fractional(df.schema[c].dataType):
            beyond = beyond & ~F.isnan(col(c))
        tests[c] = beyond
    if not tests:
        return []
    found = df.agg(*[F.count_if(t).alias(f"n{k}") for k, t in enumerate(tests.values())]).first()
    return [_first(df.where(t), key, cap, found[k]) for k, t in enumerate(tests.values())]


def corner_cases(
    df: DataFrame, main: DataFrame, key: str, cap: int, most_columns: int | None = None
) -> DataFrame:
    """Rows below p1 or above p99 of every numeric column, ``cap`` rows per column.

    ``most_columns`` looks at the first few numeric columns only.
    """
    columns = names_of(df, NUMERIC)[:most_columns]
    found = _outside(df, main, columns, 0.01, 0.99, key, cap)
    return union_all(found) if found else df.limit(0)


def tail_strata(
    df: DataFrame,
    main: DataFrame,
    stratify_by: list[str],
    key: str,
    cap: int,
    most_columns: int | None = None,
) -> DataFrame:
    """Rows outside the quartiles of the requested numeric columns, ``cap`` rows per column."""
    columns = [c for c in stratify_by if c in names_of(df, NUMERIC)][:most_columns]
    found = _outside(df, main, columns, 0.25, 0.75, key, cap)
    return union_all(found) if found else df.limit(0)


def combine(parts: list[DataFrame], key: str, target: int) -> DataFrame:
    """Union without exact duplicates, capped by key hash."""
    whole = union_all(parts).dropDuplicates()
    return whole.orderBy(_order(whole, key), _row(whole)).limit(target)


def multistage_sample(
    df: DataFrame,
    key: str,
    size: int = 100_000,
    corner_ratio: float = 0.05,
    stratify_by: list[str] | None = None,
    most_tail_rows: int = 10_000,
) -> DataFrame:
    """Random main body plus reserved room for extreme rows and, if asked, for the tails."""
    corner = int(size * corner_ratio)
    main_size = size - corner
    rows = df.count()
    if rows > main_size:
        main = random_sample(df, key, main_size, rows)
    else:
        main = df
    parts = [main]
    if stratify_by:
        parts.append(tail_strata(df, main, stratify_by, key, min(most_tail_rows, main_size // 10)))
    if corner > 0:
        parts.append(corner_cases(df, main, key, corner // 2))
    return combine(parts, key, size)


def stratified_sample(df: DataFrame, strata: str, key: str, per_stratum: int) -> DataFrame:
    """``per_stratum`` rows of each stratum.

    The rank filter runs before the shuffle too, so a stratum that holds most rows sends only
    its first ``per_stratum`` rows per task.
    """
    order = W.partitionBy(col(strata)).orderBy(_order(df, key), col(key), _row(df))
    return (
        df.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= per_stratum)
        .drop("_rank")
    )


def proportional_sample(
    df: DataFrame, strata: str, fractions: dict, seed: int = 42
) -> DataFrame:
    """A given share of each stratum, in one narrow pass."""
    return df.sampleBy(strata, fractions, seed)


def _allocation(held: list[tuple[int, float]], size: int) -> list[int]:
    """Rows to draw of strata of ``(rows, weight)``: in proportion to the weights, by largest remainders.

    Every stratum gets at least one row and none more than it has; what that takes or leaves is
    shared by the others in proportion again. The numbers add up to ``size``.
    """
    heaviest = max(w for _, w in held)
    weights = [max(w, 1e-9 * heaviest) if heaviest > 0 else n for n, w in held]

    def quotas(scale: float) -> list[float]:
        return [min(max(scale * w, 1.0), n) for (n, _), w in zip(held, weights)]

    scale = size / sum(weights)
    found = [size * w / sum(weights) for w in weights]
    if any(not 1 <= q <= n for q, (n, _) in zip(found, held)):
        low, high = 0.0, max(n / w for (n, _), w in zip(held, weights))
        for _ in range(200):
            scale = (low + high) / 2
            low, high = (scale, high) if sum(quotas(scale)) < size else (low, scale)
        found = quotas(high)
    drawn = [floor(q) for q in found]
    by_rest = sorted(range(len(held)), key=lambda k: (drawn[k] - found[k], k))
    for k in by_rest[: size - sum(drawn)]:
        drawn[k] += 1
    return drawn


def allocated_sample(
    df: DataFrame, strata: str, key: str, size: int, measure: str | None = None, weight: str = "weight"
) -> DataFrame:
    """Exactly ``size`` rows (all, where there are fewer), each stratum's by the smallest key hashes.

    Strata get rows in proportion to their sizes, with ``measure`` to size times its standard
    deviation (Neyman), at least one each; NULL is a stratum. ``weight`` (replaced where the table
    has it) is the rows of the stratum for each drawn one, so weighted totals are unbiased and the
    weights add up to the row count. At most ``MAX_STRATA`` strata, and no more than ``size``.

    Buckets of hashes are counted first: those surely drawn are only filtered, and of each stratum
    a 4096th is ranked, however large the stratum.
    """
    clean = nan_to_null(df)
    deviation = F.stddev_samp(col(measure).cast("double")) if measure else F.lit(1.0)
    facts = (
        clean.groupBy(col(strata).alias("stratum"))
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(deviation, F.lit(0.0)).alias("deviation"))
        .limit(MAX_STRATA + 1)
        .collect()
    )
    if len(facts) > min(MAX_STRATA, max(size, 0)):
        raise ValueError(f"{strata} has more strata than {min(MAX_STRATA, size)}")
    kept = [c for c in df.columns if c.lower() != weight.lower()]
    if not facts:
        return df.select(*[col(c) for c in kept], F.lit(None).cast("double").alias(weight)).limit(0)
    facts.sort(key=lambda r: (r["stratum"] is not None, r["stratum"] if r["stratum"] is not None else 0))
    size = min(size, sum(r["rows"] for r in facts))
    drawn = _allocation([(r["rows"], r["rows"] * r["deviation"]) for r in facts], size)
    plan = local_frame(
        df.sparkSession,
        [(k, r["rows"], n) for k, (r, n) in enumerate(zip(facts, drawn))],
        "k int, rows bigint, drawn bigint",
    )
    # One number per stratum, from a map of at most MAX_STRATA values.
    places = df.sparkSession.createDataFrame(
        [(k, r["stratum"]) for k, r in enumerate(facts)],
        T.StructType([T.StructField("k", T.IntegerType()), T.StructField("stratum", df.schema[strata].dataType)]),
    )
    numbered = df.withColumn("_hash", _order(df, key)).join(
        F.broadcast(places.withColumnsRenamed({"k": "_k", "stratum": "_stratum"})),
        col(strata).eqNullSafe(F.col("_stratum")),
    )
    held = numbered.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    counts = held.groupBy(F.col("_k").alias("k"), F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    last = (
        counts.withColumn("after", F.sum("n").over(upto))
        .join(F.broadcast(plan), "k")
        .where("after >= drawn AND after - n < drawn")
        .select(
            F.col("k").alias("_k"),
            F.col("bucket").alias("_last"),
            (F.col("drawn") - F.col("after") + F.col("n")).alias("_room"),
            (F.col("rows") / F.col("drawn")).alias("_weight"),
        )
    )
    # One row per stratum.
    placed = held.join(F.broadcast(last), "_k")
    order = W.partitionBy("_k").orderBy("_hash", _row(df))
    ranked = placed.where("_bucket = _last").withColumn("_rank", F.row_number().over(order))
    edge = ranked.where((F.col("_rank") <= max(drawn)) & (F.col("_rank") <= F.col("_room")))
    out = [*[col(c) for c in kept], F.col("_weight").alias(weight)]
    return placed.where("_bucket < _last").select(*out).unionAll(edge.select(*out))


def strata_columns(overview: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` columns per table to stratify by: few-valued texts, times, discrete numbers."""
    kind, distinct = F.col("family"), F.col("distinct_count")
    fits = (
        ((kind == TEXT) & distinct.between(2, 50))
        | (kind == DATETIME)
        | (kind.isin(NUMERIC, BOOLEAN) & (distinct <= 20) & (distinct < F.col("row_count") * 0.1))
    )
    order = W.partitionBy("table_name").orderBy("ordinal")
    return (
        overview.where(fits)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
        .select("table_name", "column_name", "rank")
    )


def _five_most_frequent(df: DataFrame, names: list[str]) -> DataFrame:
    order = W.partitionBy("column_name").orderBy(F.desc("n"), "key")
    key = F.coalesce("text_key", F.col("int_key").cast("string")).alias("key")
    return (
        frequencies(df, names)
        .select("column_name", key, "n")
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= 5")
        .select("column_name", "key")
    )


def sample_quality(
    full: DataFrame, sample: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """How well a sample keeps each column: mean and deviation error, or top-value overlap.

    Checks all columns unless told otherwise.
    """
    columns = columns if columns is not None else sample.columns
    columns = [c for c in columns if c in full.columns and c in sample.columns]
    numbers = [c for c in columns if family(full.schema[c].dataType) == NUMERIC]
    others = [
        c for c in columns if family(full.schema[c].dataType) not in (NUMERIC, OTHER)
    ]

    def moments(df: DataFrame, side: str) -> DataFrame:
        wide = nan_to_null(df).agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numbers)],
            *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(numbers)],
        )
        rows = [
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col(f"m{numbers.index(c)}") if c in numbers else F.lit(None).cast("double")).alias(f"{side}_mean"),
                (F.col(f"s{numbers.index(c)}") if c in numbers else F.lit(None).cast("double")).alias(f"{side}_std"),
            )
            for c in columns
        ]
        return wide.select(F.col("rows").alias(f"{side}_rows"), F.inline(F.array(*rows)))

    both = moments(full, "full").join(moments(sample, "sample"), "column_name")
    if others:
        top = _five_most_frequent(sample, others)
        hits = (
            top.join(_five_most_frequent(full, others).withColumn("hit", F.lit(1)), ["column_name", "key"], "left")
            .groupBy("column_name")
            .agg(F.try_divide(F.count("hit"), F.greatest(F.count(F.lit(1)), F.lit(1))).alias("top_value_overlap"))
        )
        both = both.join(hits, "column_name", "left")
    else:
        both = both.withColumn("top_value_overlap", F.lit(None).cast("double"))

    def error(stat: str) -> Column:
        was, now = F.col(f"full_{stat}"), F.col(f"sample_{stat}")
        return F.when(was == 0, 0.0).otherwise(F.abs(now - was) / F.abs(was)).alias(f"{stat}_error")

    return both.select(
        "column_name",
        "full_rows",
        "sample_rows",
        F.coalesce(F.try_divide("sample_rows", "full_rows"), F.lit(0.0)).alias("coverage_ratio"),
        error("mean"),
        error("std"),
        "top_value_overlap",
    )
