"""Association, drift, distribution summaries, guesses about columns, masking."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablescout.functions.local import settle, work_folder
from tablescout.operators import associate as a
from tablescout.operators import cells
from tablescout.operators import drift as d
from tablescout.operators import shape as s
from tablescout.operators.profile import column_overview, column_stats
from tablescout.operators.validate import outlier_rows
from tablescout.queries import inputs as i
from tablescout.sources import table_schema

PAIRED = [
    ("documents", ["lang", "source"]),
    ("lineitem", ["l_linestatus", "l_returnflag"]),
    ("orders_dirty", ["o_orderpriority", "o_orderstatus"]),
    ("part", ["p_brand", "p_type"]),
]


def _associations(*fields):
    def query(spark, sf):
        parts = [
            a.associations(i.table(spark, sf, t), columns).select(F.lit(t).alias("table_name"), "*")
            for t, columns in PAIRED
        ]
        out = i.union(parts).select("table_name", "col_a", "col_b", *fields)
        doubles = [f for f in fields if f not in ("n", "dof")]
        return i.rounded(out, 5, *doubles)

    return query


COMPARED = [
    ("customer", "c_acctbal", "supplier", "s_acctbal"),
    ("lineitem", "l_quantity", "part", "p_size"),
    ("orders", "o_totalprice", "lineitem", "l_extendedprice"),
]


def _ks(spark, sf):
    parts = [
        d.ks_statistic(i.table(spark, sf, t), c, i.table(spark, sf, u), e).select(
            F.lit(f"{t}.{c}|{u}.{e}").alias("pair"), "*"
        )
        for t, c, u, e in COMPARED
    ]
    return i.rounded(i.union(parts), 6, "ks", "p_value")


CUT = "2024-01-16"


def _recent():
    return F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")


def _drift_numeric(spark, sf):
    out = d.drift_numeric(i.table(spark, sf, "events"), _recent(), ["user_id", "value"])
    return i.rounded(out, 6, "ks", "p_value")


def _drift_categorical(spark, sf):
    out = d.drift_categorical(i.table(spark, sf, "events"), _recent(), ["event_type", "props"])
    return i.rounded(out, 6, "total_variation")


def _mutual_numeric(spark, sf):
    out = cells.mixed_associations(i.tables(spark, sf, i.GIVEN)).select(
        "table_name", "col_a", "col_b", "n", "mutual_information"
    )
    return i.rounded(out, 5, "mutual_information")


# Table, time, granularity, two windows, and the periods on either side of a change.
WINDOWED = [
    ("events", "ts", "day", ("2024-01-01", "2024-01-08"), ("2024-01-16", "2024-01-23"), 7),
    ("orders", "o_orderdate", "month", ("1995-01-01", "1996-01-01"), ("2000-01-01", "2001-01-01"), 12),
]


def _drift_windows(spark, sf):
    """Drift of two windows beside the period of the largest change; both from one table of counts."""
    folder, parts = work_folder(spark), []
    for t, time, grain, first, second, span in WINDOWED:
        counts = settle(cells.period_counts(i.table(spark, sf, t), time, grain), folder, t)
        both = cells.window_drift(counts, first, second).join(
            cells.largest_change(counts, span), "column_name", "left"
        )
        parts.append(both.select(F.lit(t).alias("table_name"), "*"))
    return i.timed(i.rounded(i.union(parts), 6, "total_variation", "change"), "change_period")


def _entropy(spark, sf):
    return i.rounded(a.column_entropy(i.tables(spark, sf, i.PROFILED)), 6, "entropy")


def _freshness(spark, sf):
    out = d.freshness(i.tables(spark, sf, i.PROFILED), F.lit("2024-02-01").cast("date"))
    return i.timed(out, "latest")


BINNED = i.PROFILED


def _histogram(spark, sf):
    return s.histogram(i.tables(spark, sf, BINNED))


BOX = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def _box(spark, sf):
    return i.rounded(s.box_stats(i.tables(spark, sf, BINNED)), 4, *BOX)


def _outlier_rows(spark, sf):
    out = outlier_rows(i.table(spark, sf, "events"), "value")
    return i.rounded(
        out.select("event_id", "value", "lower_bound", "upper_bound"), 4, "lower_bound", "upper_bound"
    )


def _constraints(spark, sf):
    tables = i.tables(spark, sf, BINNED)
    return s.constraint_guesses(column_overview(tables), tables)


SCANNED = i.PROFILED + ["contacts"]


def _sensitive(spark, sf):
    return i.rounded(s.sensitive_columns(i.tables(spark, sf, SCANNED)), 6, "share")


def _masked(spark, sf):
    contacts = s.masked(i.table(spark, sf, "contacts"), ["email"], ["c_custkey"])
    documents = s.masked(i.table(spark, sf, "documents"), ["text"], ["doc_id"])
    return contacts.select(
        F.lit("contacts").alias("table_name"), F.col("c_custkey").alias("key"), F.md5("email").alias("text")
    ).unionByName(
        documents.select(
            F.lit("documents").alias("table_name"), F.col("doc_id").alias("key"), F.md5("text").alias("text")
        )
    )


def _semantic(spark, sf):
    return s.semantic_types(column_overview(i.tables(spark, sf, TYPED)))


TYPED = i.PROFILED + ["contacts", "events_mixed", "events_text_time"]
CONFLICTING = ["events", "events_mixed", "events_text_time", "orders", "orders_dirty"]


def _conflicts(spark, sf):
    """Conflicts beside the values at stake."""
    tables = i.tables(spark, sf, CONFLICTING)
    values = column_stats(tables, []).groupBy("column_name").agg(F.sum("present_count").alias("values"))
    return s.schema_conflicts(table_schema(spark, tables)).join(values, "column_name")


QUERIES = {
    "cramers_v": _associations("n", "cramers_v"),
    "chi_square": _associations("n", "chi_square", "dof", "p_value"),
    "mutual_information": _associations("n", "mutual_information"),
    "mutual_information_numeric": _mutual_numeric,
    "ks_statistic": _ks,
    "drift_windows": _drift_windows,
    "drift_numeric": _drift_numeric,
    "drift_categorical": _drift_categorical,
    "column_entropy": _entropy,
    "freshness": _freshness,
    "histogram": _histogram,
    "box_stats": _box,
    "outlier_rows": _outlier_rows,
    "constraint_guess": _constraints,
    "sensitive_columns": _sensitive,
    "masked_sample": _masked,
    "semantic_types": _semantic,
    "schema_conflicts": _conflicts,
}


def _association_select(t, columns):
    x, y = sorted(columns)
    return f"""SELECT '{t}' AS table_name, '{x}' AS col_a, '{y}' AS col_b, n,
      greatest(n * (ratio - 1), 0) AS chi_square, (ra - 1) * (rb - 1) AS dof,
      CASE WHEN least(ra, rb) < 2 THEN 0 ELSE
        sqrt(greatest(n * (ratio - 1), 0) / (n * (least(ra, rb) - 1))) END AS cramers_v,
      greatest(logs / n + ln(n), 0) AS mutual_information
      FROM (SELECT CAST(sum(o) AS BIGINT) AS n, sum(o * o / (r * c)) AS ratio,
        sum(o * ln(o / (r * c))) AS logs, count(DISTINCT a) AS ra, count(DISTINCT b) AS rb
      FROM (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c
        FROM (SELECT {x} AS a, {y} AS b, CAST(count(*) AS DOUBLE) AS o FROM {t}
          WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2)))"""


_ASSOC = i.union_sql([_association_select(*p) for p in PAIRED])


def _coded_cte(t: str) -> str:
    """``coded_<t>``: numbers as cells, texts as they are where they have 2 to 100 values, else NULL."""
    numbers, texts = [x[1] for x in i.columns_of([t], "numeric")], [x[1] for x in i.columns_of([t], "text")]
    shares = [k / cells.CELLS for k in range(1, cells.CELLS)]
    facts = [
        f"list_distinct([CAST(printf('%.12g', x) AS DOUBLE) FOR x IN quantile_cont({c}::DOUBLE, {shares})]) AS e_{c}"
        for c in numbers
    ] + [f"count(DISTINCT {c}) BETWEEN 2 AND {cells.MOST_VALUES} AS f_{c}" for c in texts]
    out = [
        f"CASE WHEN {c} IS NOT NULL THEN CAST(len([e FOR e IN e_{c} IF e <= {c}::DOUBLE]) AS VARCHAR) END AS {c}"
        for c in numbers
    ] + [f"CASE WHEN f_{c} THEN {c} END AS {c}" for c in texts]
    times = [x[1] for x in i.columns_of([t], "datetime")]
    return f"coded_{t} AS (SELECT {', '.join(out + times)} FROM {t}, (SELECT {', '.join(facts)} FROM {t}))"


_MIXED = [
    (t, x, y)
    for t in i.GIVEN
    for x, y in combinations(sorted(c for _, c in i.columns_of([t], "numeric", "text")), 2)
]


def _mixed_select(t, x, y):
    return f"""SELECT '{t}' AS table_name, '{x}' AS col_a, '{y}' AS col_b, n,
      round(greatest(logs / n + ln(n), 0), 5) AS mutual_information
      FROM (SELECT CAST(sum(o) AS BIGINT) AS n, sum(o * ln(o / (r * c))) AS logs
      FROM (SELECT o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c
        FROM (SELECT {x} AS a, {y} AS b, CAST(count(*) AS DOUBLE) AS o FROM coded_{t}
          WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2))) WHERE n > 0"""


def _windows_select(t, time, grain, first, second, span):
    """Both parts from the rows themselves, without running counts."""
    within = [f"p >= TIMESTAMP '{w[0]}' AND p < TIMESTAMP '{w[1]}'" for w in (first, second)]
    spread = i.union_sql(
        [
            f"SELECT '{c}' AS column_name, date_trunc('{grain}', {time}) AS p, {c} AS cell FROM coded_{t} "
            f"WHERE {c} IS NOT NULL"
            for _, c in i.columns_of([t], "numeric", "text")
        ]
    )
    return f"""SELECT '{t}' AS table_name, column_name, n_first, n_second, total_variation, change_period, change
      FROM (WITH spread AS MATERIALIZED ({spread}),
        cells AS (SELECT column_name, cell, count(*) FILTER ({within[0]}) AS n1,
          count(*) FILTER ({within[1]}) AS n2 FROM spread GROUP BY 1, 2),
        totals AS (SELECT *, sum(n1) OVER w AS t1, sum(n2) OVER w AS t2 FROM cells
          WINDOW w AS (PARTITION BY column_name)),
        fixed AS (SELECT column_name, CAST(max(t1) AS BIGINT) AS n_first, CAST(max(t2) AS BIGINT) AS n_second,
          round(sum(abs(n1 / t1 - n2 / t2)) / 2, 6) AS total_variation FROM totals GROUP BY 1),
        periods AS (SELECT column_name, p, row_number() OVER (PARTITION BY column_name ORDER BY p) AS k,
          count(*) OVER (PARTITION BY column_name) AS many FROM (SELECT DISTINCT column_name, p FROM spread)),
        sides AS (SELECT a.column_name, a.p, s.cell, count(*) FILTER (b.k < a.k) AS n1,
          count(*) FILTER (b.k >= a.k) AS n2
          FROM periods a JOIN periods b ON a.column_name = b.column_name AND b.k BETWEEN a.k - {span} AND a.k + {span} - 1
          JOIN spread s ON s.column_name = b.column_name AND s.p = b.p
          WHERE a.k > {span} AND a.k + {span} - 1 <= a.many GROUP BY 1, 2, 3),
        moved AS (SELECT column_name, p, round(sum(abs(n1 / t1 - n2 / t2)) / 2, 9) AS change
          FROM (SELECT *, sum(n1) OVER w AS t1, sum(n2) OVER w AS t2 FROM sides
            WINDOW w AS (PARTITION BY column_name, p)) GROUP BY 1, 2),
        best AS (SELECT column_name, strftime(p, '%Y-%m-%d %H:%M:%S') AS change_period, round(change, 6) AS change
          FROM moved QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY change DESC, p) = 1)
      SELECT * FROM fixed LEFT JOIN best USING (column_name))"""


_STEPS = 20_000  # of the quadrature; even


def _ks_select(values: str, label: str) -> str:
    """The statistic, and its limit distribution's alternating series."""
    name = label.split(" AS ")[1]
    return f"""SELECT {name}, n_first, n_second, ks, CASE WHEN n_first > 0 AND n_second > 0 THEN
      round(least(1, greatest(0, CASE WHEN z < 0.04 THEN 1 ELSE 2 * list_sum([
        CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * z * z) FOR j IN range(1, 500)]) END)), 6)
      END AS p_value
      FROM (SELECT *, (sqrt(e) + 0.12 + 0.11 / sqrt(e)) * exact AS z
        FROM (SELECT *, n_first::DOUBLE * n_second / (n_first + n_second) AS e
          FROM ({_ks_gap(values, label)})))"""


def _ks_gap(values: str, label: str) -> str:
    return f"""SELECT {label}, t1 AS n_first, t2 AS n_second, max(abs(f1 / t1 - f2 / t2)) AS exact, round(exact, 6) AS ks
      FROM (SELECT CAST(sum(n1) OVER (ORDER BY v) AS BIGINT) AS f1,
          CAST(sum(n2) OVER (ORDER BY v) AS BIGINT) AS f2,
          CAST(sum(n1) OVER () AS BIGINT) AS t1, CAST(sum(n2) OVER () AS BIGINT) AS t2
        FROM (SELECT v, count(*) FILTER (NOT second) AS n1, count(*) FILTER (second) AS n2
          FROM ({values}) GROUP BY v)) GROUP BY ALL"""


def _histogram_select(t, c):
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(coalesce(least(floor(
        CASE WHEN hi > lo THEN ({c}::DOUBLE - lo) / (hi - lo) END * 10), 9), 0) AS BIGINT) AS bin,
      count(*) AS n FROM {t}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {t})
      WHERE {c} IS NOT NULL GROUP BY bin"""


def _redact(c: str) -> str:
    for pattern in s.SENSITIVE_PATTERNS.values():
        c = f"regexp_replace({c}, '{pattern}', '{s.MASK}', 'g')"
    return c


_SENSITIVE = i.union_sql(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS kind, "
        f"count(*) FILTER (regexp_matches({c}, '{pattern}')) AS matches, count({c}) AS n FROM {t}"
        for t, c in i.columns_of(SCANNED, "text")
        for kind, pattern in s.SENSITIVE_PATTERNS.items()
    ]
)
_DRIFTING = f"ts >= TIMESTAMP '{CUT}'"

SQL = {
    "cramers_v": i.with_inputs(
        ["orders_dirty"],
        f"SELECT table_name, col_a, col_b, n, round(cramers_v, 5) AS cramers_v FROM ({_ASSOC})",
    ),
    "chi_square": i.with_inputs(
        ["orders_dirty"],
        # The gamma density of shape dof / 2 from half the statistic on, by Simpson.
        f"""SELECT table_name, col_a, col_b, n, round(chi_square, 5) AS chi_square, dof,
          CASE WHEN dof > 0 THEN CASE WHEN chi_square <= 0 THEN 1 ELSE round(least(share, 1), 5) END
            END AS p_value
        FROM ({_ASSOC}) LEFT JOIN (SELECT table_name, col_a, col_b, any_value(width / 3) * sum(
            CASE WHEN k IN (0, {_STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
            * exp((a - 1) * ln(x + width * k) - (x + width * k) - lgamma(a))) AS share
          FROM (SELECT *, (greatest(a - x, 0) + 40 * sqrt(a) + 100) / {_STEPS} AS width
            FROM (SELECT *, dof / 2.0::DOUBLE AS a, chi_square / 2 AS x FROM ({_ASSOC})
              WHERE chi_square > 0 AND dof > 0)), range({_STEPS} + 1) AS steps(k)
          GROUP BY ALL) USING (table_name, col_a, col_b)""",
    ),
    "mutual_information": i.with_inputs(
        ["orders_dirty"],
        "SELECT table_name, col_a, col_b, n, round(mutual_information, 5) AS mutual_information "
        f"FROM ({_ASSOC})",
    ),
    "mutual_information_numeric": i.with_inputs(
        i.GIVEN,
        i.union_sql([_mixed_select(*x) for x in _MIXED]),
        *[_coded_cte(t) for t in sorted({x[0] for x in _MIXED})],
    ),
    "drift_windows": i.with_inputs(
        ["events", "orders"],
        i.union_sql([_windows_select(*x) for x in WINDOWED]),
        *[_coded_cte(x[0]) for x in WINDOWED],
    ),
    "ks_statistic": i.union_sql(
        [
            _ks_select(
                f"SELECT {c}::DOUBLE AS v, false AS second FROM {t} "
                f"UNION ALL SELECT {e}::DOUBLE, true FROM {u}",
                f"'{t}.{c}|{u}.{e}' AS pair",
            )
            for t, c, u, e in COMPARED
        ]
    ),
    "drift_numeric": i.union_sql(
        [
            _ks_select(
                f"SELECT {c}::DOUBLE AS v, {_DRIFTING} AS second FROM events", f"'{c}' AS column_name"
            )
            for c in ("user_id", "value")
        ]
    ),
    "drift_categorical": i.union_sql(
        [
            f"""SELECT '{c}' AS column_name, CAST(max(t1) AS BIGINT) AS n_first,
          CAST(max(t2) AS BIGINT) AS n_second, round(sum(abs(n1 / t1 - n2 / t2)) / 2, 6) AS total_variation
          FROM (SELECT n1, n2, sum(n1) OVER () AS t1, sum(n2) OVER () AS t2 FROM (
            SELECT {c}, count(*) FILTER (NOT {_DRIFTING}) AS n1, count(*) FILTER ({_DRIFTING}) AS n2
            FROM events GROUP BY 1))"""
            for c in ("event_type", "props")
        ]
    ),
    "column_entropy": i.with_inputs(
        i.PROFILED,
        """SELECT table_name, column_name, count(*) AS distinct_count,
          round(greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0), 6) AS entropy
        FROM freq GROUP BY 1, 2""",
        i.frequency_cte(i.PROFILED),
    ),
    "freshness": i.with_inputs(
        i.PROFILED,
        i.union_sql(
            [
                f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
          strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS latest,
          date_diff('day', CAST(max({c}) AS DATE), DATE '2024-02-01') AS age_days FROM {t}"""
                for t, c in i.columns_of(i.PROFILED, "datetime")
            ]
        ),
    ),
    "histogram": i.with_inputs(
        BINNED, i.union_sql([_histogram_select(*x) for x in i.columns_of(BINNED, "numeric")])
    ),
    "box_stats": i.with_inputs(
        BINNED,
        i.union_sql(
            [
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                + ", ".join(f"round(quantile_cont({c}::DOUBLE, {q}), 4) AS {x}" for x, q in BOX.items())
                + f" FROM {t}"
                for t, c in i.columns_of(BINNED, "numeric")
            ]
        ),
    ),
    "outlier_rows": """SELECT event_id, value, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound
      FROM events, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
        SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))
      WHERE value < lo OR value > hi""",
    "constraint_guess": i.with_inputs(
        BINNED,
        """SELECT table_name, column_name, 'not_null' AS "constraint", '' AS detail FROM overview
          WHERE row_count > 0 AND null_count = 0
        UNION ALL SELECT table_name, column_name, 'unique', '' FROM overview
          WHERE row_count > 0 AND null_count = 0 AND distinct_count = row_count
        UNION ALL SELECT table_name, column_name, 'value_set', string_agg(value, ', ' ORDER BY value)
          FROM freq JOIN (SELECT table_name, column_name FROM overview WHERE family = 'text'
            AND distinct_count BETWEEN 1 AND 20) USING (table_name, column_name) GROUP BY 1, 2""",
        i.overview_cte(BINNED),
        i.frequency_cte(BINNED),
    ),
    "sensitive_columns": i.with_inputs(
        SCANNED,
        "SELECT table_name, column_name, kind, matches, round(matches / n, 6) AS share "
        f"FROM ({_SENSITIVE}) WHERE matches > 0",
    ),
    "masked_sample": i.with_inputs(
        ["contacts"],
        f"""SELECT 'contacts' AS table_name, sha256(CAST(c_custkey AS VARCHAR)) AS key,
          md5({_redact('email')}) AS text FROM contacts
        UNION ALL SELECT 'documents', sha256(CAST(doc_id AS VARCHAR)), md5({_redact('text')})
          FROM documents""",
    ),
    "semantic_types": i.with_inputs(
        TYPED,
        f"""SELECT table_name, column_name, CASE WHEN family = 'datetime' THEN 'date-time'
          WHEN family = 'text' AND iso_date_count > present_count * 0.9 THEN 'date-time'
          WHEN regexp_matches(lower(column_name), '{i.KEY_PATTERN}') OR (distinct_count = present_count
            AND present_count > 1 AND (integral OR family = 'text') AND max_length <= 64)
            THEN 'identifier'
          WHEN family = 'boolean' THEN 'categorical'
          WHEN family = 'text' AND distinct_count <= 100 THEN 'categorical'
          WHEN family = 'text' THEN 'free text' WHEN numeric_role = 'dimension' THEN 'categorical'
          WHEN family = 'numeric' THEN 'continuous' ELSE 'other' END AS semantic_type FROM overview""",
        i.overview_cte(TYPED),
    ),
    "schema_conflicts": i.with_inputs(
        CONFLICTING,
        """SELECT column_name, string_agg(DISTINCT dtype, ', ' ORDER BY dtype) AS dtypes,
          count(DISTINCT dtype) AS types, count(*) AS tables, CAST(sum(present_count) AS BIGINT) AS "values"
        FROM overview GROUP BY 1 HAVING count(DISTINCT dtype) > 1""",
        i.overview_cte(CONFLICTING),
    ),
}
