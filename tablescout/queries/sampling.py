"""Sampling by key hash, extreme rows, strata, sample quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import sampling as s
from tablescout.operators.profile import column_overview
from tablescout.queries import inputs as i

SIZE = 2000
PERCENT = 20
FRACTION_LIMIT = f"{round(16**8 * PERCENT / 100):08x}"


def _orders(spark, sf):
    return i.table(spark, sf, "orders")


def _random_sample(spark, sf):
    return i.timed(s.random_sample(_orders(spark, sf), "o_orderkey", SIZE), "o_orderdate")


def _multistage(spark, sf):
    out = s.multistage_sample(_orders(spark, sf), "o_orderkey", SIZE, 0.05, ["o_totalprice"])
    return i.timed(out, "o_orderdate")


def _main(df):
    return s.hashed_sample(df, "o_orderkey", PERCENT)


def _corner_cases(spark, sf):
    orders = _orders(spark, sf)
    return i.timed(s.corner_cases(orders, _main(orders), "o_orderkey", 50), "o_orderdate")


def _tail_strata(spark, sf):
    orders = _orders(spark, sf)
    return i.timed(
        s.tail_strata(orders, _main(orders), ["o_custkey", "o_totalprice"], "o_orderkey", 200),
        "o_orderdate",
    )


def _union_dedup(spark, sf):
    dirty = i.table(spark, sf, "orders_dirty")
    parts = [dirty, s.hashed_sample(dirty, "o_orderkey", PERCENT)]
    return i.timed(s.combine(parts, "o_orderkey", 10 * SIZE), "o_orderdate")


def _strata_columns(spark, sf):
    return s.strata_columns(column_overview(i.tables(spark, sf, i.PROFILED)))


def _sample_quality(spark, sf):
    full = i.table(spark, sf, "events")
    columns = ["event_id", "user_id", "event_type", "value", "ts"]
    quality = s.sample_quality(full, s.hashed_sample(full, "event_id", PERCENT), columns)
    return i.rounded(
        quality, 6, "coverage_ratio", "mean_error", "std_error", "top_value_overlap"
    )


def _stratified(spark, sf):
    return i.timed(
        s.stratified_sample(_orders(spark, sf), "o_orderpriority", "o_orderkey", 100), "o_orderdate"
    )


ALLOCATED = 500


def _allocated(spark, sf):
    """Proportional to the strata's sizes, and to size times deviation of the price."""
    orders, parts = _orders(spark, sf), []
    for method, measure in (("proportional", None), ("neyman", "o_totalprice")):
        drawn = s.allocated_sample(orders, "o_orderpriority", "o_orderkey", ALLOCATED, measure)
        parts.append(drawn.select(F.lit(method).alias("method"), "o_orderkey", "o_orderpriority", "weight"))
    return i.rounded(i.union(parts), 6, "weight")


QUERIES = {
    "random_sample": _random_sample,
    "multistage_sample": _multistage,
    "corner_case_rows": _corner_cases,
    "tail_strata_rows": _tail_strata,
    "sample_union_dedup": _union_dedup,
    "strata_columns": _strata_columns,
    "sample_quality": _sample_quality,
    "stratified_sample": _stratified,
    "allocated_sample": _allocated,
}

_DATED = "* REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate)"
_HASH = "md5(CAST(o_orderkey AS VARCHAR))"


def _drawn(size: int) -> str:
    """CTE of the main random body of about ``size`` rows."""
    return f"""(SELECT o.* FROM orders o,
      (SELECT least(100.0, greatest(0.1, {size} / count(*) * 100)) AS pct FROM orders) p
      WHERE pct >= 100 OR substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) <
        printf('%08x', CAST(round(4294967296 * least(pct, 99.999999) / 100) AS BIGINT))
      ORDER BY {_HASH} LIMIT {size})"""


def _beyond(column: str, low: float, high: float, cap: int, main: str = "main") -> str:
    return f"""(SELECT o.* FROM orders o, (SELECT quantile_cont({column}::DOUBLE, {low}) AS lo,
      quantile_cont({column}::DOUBLE, {high}) AS hi FROM {main}) e
      WHERE {column} < lo OR {column} > hi ORDER BY {_HASH} LIMIT {cap})"""


_MAIN = (
    f"main AS (SELECT * FROM orders WHERE substr({_HASH}, 1, 8) < '{FRACTION_LIMIT}')"
)

SQL = {
    "random_sample": f"SELECT {_DATED} FROM {_drawn(SIZE)}",
    "multistage_sample": f"""WITH main AS (
      SELECT * FROM {_drawn(SIZE - 100)} WHERE (SELECT count(*) FROM orders) > {SIZE - 100}
      UNION ALL SELECT * FROM orders WHERE (SELECT count(*) FROM orders) <= {SIZE - 100})
      SELECT {_DATED} FROM (SELECT * FROM (
        SELECT * FROM main
        UNION SELECT * FROM {_beyond('o_totalprice', 0.25, 0.75, (SIZE - 100) // 10)}
        UNION SELECT * FROM {_beyond('o_orderkey', 0.01, 0.99, 50)}
        UNION SELECT * FROM {_beyond('o_custkey', 0.01, 0.99, 50)}
        UNION SELECT * FROM {_beyond('o_totalprice', 0.01, 0.99, 50)})
      ORDER BY {_HASH} LIMIT {SIZE})""",
    "corner_case_rows": f"""WITH {_MAIN} SELECT {_DATED} FROM (
      SELECT * FROM {_beyond('o_orderkey', 0.01, 0.99, 50)}
      UNION ALL SELECT * FROM {_beyond('o_custkey', 0.01, 0.99, 50)}
      UNION ALL SELECT * FROM {_beyond('o_totalprice', 0.01, 0.99, 50)})""",
    "tail_strata_rows": f"""WITH {_MAIN} SELECT {_DATED} FROM (
      SELECT * FROM {_beyond('o_custkey', 0.25, 0.75, 200)}
      UNION ALL SELECT * FROM {_beyond('o_totalprice', 0.25, 0.75, 200)})""",
    "sample_union_dedup": i.with_inputs(
        ["orders_dirty"],
        f"""SELECT {_DATED} FROM (SELECT * FROM (SELECT * FROM orders_dirty UNION
          SELECT * FROM orders_dirty WHERE substr({_HASH}, 1, 8) < '{FRACTION_LIMIT}')
          ORDER BY {_HASH} LIMIT {10 * SIZE})""",
    ),
    "strata_columns": i.with_inputs(
        i.PROFILED,
        """SELECT table_name, column_name, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS rank
          FROM overview WHERE (family = 'text' AND distinct_count BETWEEN 2 AND 50)
            OR family = 'datetime' OR (family IN ('numeric', 'boolean')
              AND distinct_count <= 20 AND distinct_count < row_count * 0.1))
        WHERE rank <= 3""",
        i.overview_cte(i.PROFILED),
    ),
    "allocated_sample": f"""WITH sizes AS (SELECT o_orderpriority, count(*) AS n,
        stddev_samp(o_totalprice) AS dev FROM orders GROUP BY 1),
      quotas AS (SELECT method, o_orderpriority, n, {ALLOCATED} * w / sum(w) OVER (PARTITION BY method) AS q FROM (
        SELECT 'proportional' AS method, *, n AS w FROM sizes UNION ALL SELECT 'neyman', *, n * dev FROM sizes)),
      allocated AS (SELECT *, floor(q) + CASE WHEN row_number() OVER (
          PARTITION BY method ORDER BY q - floor(q) DESC, o_orderpriority)
          <= {ALLOCATED} - sum(floor(q)) OVER (PARTITION BY method) THEN 1 ELSE 0 END AS take FROM quotas)
      SELECT method, o_orderkey, o_orderpriority, round(n / take, 6) AS weight FROM allocated
      JOIN (SELECT o_orderkey, o_orderpriority, row_number() OVER (
        PARTITION BY o_orderpriority ORDER BY {_HASH}) AS r FROM orders) USING (o_orderpriority)
      WHERE r <= take""",
    "sample_quality": f"""WITH sample AS (SELECT * FROM events
        WHERE substr(md5(CAST(event_id AS VARCHAR)), 1, 8) < '{FRACTION_LIMIT}'),
      sizes AS (SELECT (SELECT count(*) FROM events) AS full_rows,
        (SELECT count(*) FROM sample) AS sample_rows),
      tops AS ("""
    + i.union_sql(
        [
            f"""SELECT '{c}' AS column_name, count(f.v) / greatest(count(*), 1) AS overlap FROM
          (SELECT {c} AS v FROM sample GROUP BY 1 ORDER BY count(*) DESC, {o} LIMIT 5) t LEFT JOIN
          (SELECT {c} AS v FROM events GROUP BY 1 ORDER BY count(*) DESC, {o} LIMIT 5) f USING (v)"""
            for c, o in (("event_type", "1"), ("ts", "CAST(epoch_us(ts) AS VARCHAR)"))
        ]
    )
    + ") "
    + i.union_sql(
        [
            f"""SELECT '{c}' AS column_name, full_rows, sample_rows,
          round(sample_rows / full_rows, 6) AS coverage_ratio,
          (SELECT round(abs((SELECT avg({c}) FROM sample) - avg({c})) / abs(avg({c})), 6) FROM events)
            AS mean_error,
          (SELECT round(abs((SELECT stddev_samp({c}) FROM sample) - stddev_samp({c}))
            / abs(stddev_samp({c})), 6) FROM events) AS std_error,
          NULL::DOUBLE AS top_value_overlap FROM sizes"""
            for c in ("event_id", "user_id", "value")
        ]
        + [
            """SELECT column_name, full_rows, sample_rows, round(sample_rows / full_rows, 6),
          NULL::DOUBLE, NULL::DOUBLE, round(overlap, 6) FROM sizes, tops"""
        ]
    ),
    "stratified_sample": f"""SELECT {_DATED} FROM (SELECT * FROM orders QUALIFY row_number() OVER
      (PARTITION BY o_orderpriority ORDER BY {_HASH}, o_orderkey) <= 100)""",
}
