"""Pearson and Spearman matrices and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import correlate as c
from tablescout.queries import inputs as i
from tablescout.queries.scans import pearson_cte

TABLES = i.PROFILED + ["lineitem_corr"]
RANKED = [t for t in TABLES if len(i.columns_of([t], "numeric")) > 1]


def _pearson(spark, sf, names=TABLES):
    return c.pearson(i.tables(spark, sf, names))


def _pearson_matrix(spark, sf):
    out = _pearson(spark, sf).select("table_name", "col_a", "col_b", "r", "n")
    return i.rounded(out, 6, "r")


def _spearman_matrix(spark, sf):
    out = c.spearman(i.tables(spark, sf, RANKED)).select("table_name", "col_a", "col_b", "r", "n")
    return i.rounded(out, 6, "r")


def _strong(spark, sf):
    out = c.strong_pairs(_pearson(spark, sf)).select("table_name", "col_a", "col_b", "r")
    return i.rounded(out, 6, "r")


def _correlates(spark, sf):
    out = c.column_correlates(_pearson(spark, sf), threshold=0.3)
    return i.rounded(out.select("table_name", "col_a", "col_b", "r", "rank"), 6, "r")


HEATMAP = ["constant", "l_extendedprice", "l_quantity", "net_price"]


def _heatmap(spark, sf):
    return i.rounded(c.heatmap(_pearson(spark, sf, ["lineitem_corr"]), HEATMAP), 6, *HEATMAP)


def _correlation_t(spark, sf):
    out = c.correlation_t(_pearson(spark, sf))
    return i.rounded(out.select("table_name", "col_a", "col_b", "n", "r", "t", "p_value"), 5, "r", "t", "p_value")


QUERIES = {
    "pearson_matrix": _pearson_matrix,
    "spearman_matrix": _spearman_matrix,
    "strong_correlations": _strong,
    "column_correlates": _correlates,
    "correlation_heatmap": _heatmap,
    "correlation_t": _correlation_t,
}


def _spearman_select(t: str, a: str, b: str) -> str:
    def rank(x: str) -> str:
        return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"

    return f"""SELECT '{t}' AS table_name, '{a}' AS col_a, '{b}' AS col_b, corr(ra, rb) AS r0,
      count(*) AS n FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM {t}
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def _ranked_pairs() -> str:
    parts = []
    for t in RANKED:
        names = sorted(x for _, x in i.columns_of([t], "numeric"))
        parts += [_spearman_select(t, a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    return i.union_sql(parts)


_STEPS = 4000  # of the quadrature; even

_BOTH = """both_ways AS (SELECT table_name, col_a, col_b, r FROM pearson
  UNION ALL SELECT table_name, col_b, col_a, r FROM pearson)"""

SQL = {
    "pearson_matrix": i.with_inputs(
        TABLES,
        "SELECT table_name, col_a, col_b, round(r, 6) AS r, n FROM pearson",
        pearson_cte(TABLES),
    ),
    "spearman_matrix": i.with_inputs(
        RANKED,
        "SELECT table_name, col_a, col_b, "
        "round(CASE WHEN r0 IS NULL OR isnan(r0) THEN 0 ELSE r0 END, 6) AS r, n FROM ranked",
        f"ranked AS ({_ranked_pairs()})",
    ),
    "strong_correlations": i.with_inputs(
        TABLES,
        "SELECT table_name, col_a, col_b, round(r, 6) AS r FROM pearson WHERE abs(r) >= 0.7",
        pearson_cte(TABLES),
    ),
    "column_correlates": i.with_inputs(
        TABLES,
        """SELECT table_name, col_a, col_b, round(r, 6) AS r, rank FROM (SELECT *, row_number()
          OVER (PARTITION BY table_name, col_a ORDER BY abs(r) DESC, col_b) AS rank
          FROM both_ways WHERE abs(r) >= 0.3) WHERE rank <= 10""",
        pearson_cte(TABLES),
        _BOTH,
    ),
    "correlation_heatmap": i.with_inputs(
        ["lineitem_corr"],
        "SELECT col_a, "
        + ", ".join(f"round(max(r) FILTER (col_b = '{x}'), 6) AS {x}" for x in HEATMAP)
        + " FROM (SELECT col_a, col_b, r FROM both_ways UNION ALL "
        + " UNION ALL ".join(f"SELECT '{x}', '{x}', 1.0" for x in HEATMAP)
        + ") GROUP BY col_a",
        pearson_cte(["lineitem_corr"]),
        _BOTH,
    ),
    "correlation_t": i.with_inputs(
        TABLES,
        """SELECT table_name, col_a, col_b, n, round(r, 5) AS r, round(t, 5) AS t,
          CASE WHEN t IS NULL OR n <= 2 THEN NULL WHEN t = 0 THEN 1
            ELSE round(least(greatest(share, 0), 1), 5) END AS p_value
        FROM tested LEFT JOIN areas USING (table_name, col_a, col_b)""",
        pearson_cte(TABLES),
        """tested AS (SELECT *, CASE WHEN 1 - r * r > 2e-6 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t,
          n - 2.0::DOUBLE AS v FROM pearson)""",
        # 2 Gamma((v+1)/2) / (sqrt(pi) Gamma(v/2)) times the integral of cos^(v-1), by Simpson.
        f"""bounds AS (SELECT *, atan(abs(t) / sqrt(v)) AS low,
          least(pi() / 2, atan(abs(t) / sqrt(v)) + 40 / sqrt(v)) AS high,
          CASE WHEN v < 300 THEN exp(lgamma((v + 1) / 2) - lgamma(v / 2)) ELSE sqrt(v / 2) *
            (1 - 1 / (4 * v) + 1 / (32 * v * v) + 5 / (128 * v * v * v)) END AS ratio
          FROM tested WHERE t IS NOT NULL AND v > 0),
        areas AS (SELECT table_name, col_a, col_b, any_value(2 * ratio / sqrt(pi())
            * (high - low) / {_STEPS} / 3) * sum(
            CASE WHEN k IN (0, {_STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
            * CASE WHEN v = 1 THEN 1 ELSE pow(greatest(cos(low + (high - low) * k / {_STEPS}), 1e-300), v - 1) END) AS share
          FROM bounds, range({_STEPS} + 1) AS steps(k) GROUP BY ALL)""",
    ),
}
