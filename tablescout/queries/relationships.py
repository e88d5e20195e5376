"""Relationships between columns of different tables and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions.local import settle, work_folder
from tablescout.functions.text import KEY_PATTERN
from tablescout.operators import relate as r
from tablescout.operators.profile import column_overview
from tablescout.operators.setsketch import approx_overlaps, column_sketches
from tablescout.queries import inputs as i
from tablescout.sources import table_schema

ALL = i.GIVEN
SOURCES = {
    "crm": ["customer", "nation", "region", "supplier"],
    "shop": ["events", "lineitem", "orders", "part"],
    "corpus": ["benchmark", "conversations", "documents", "embeddings", "labels", "pages"],
}
OVERLAPS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_custkey", "orders_orphan", "o_custkey"),
    ("orders_orphan", "o_custkey", "customer", "c_custkey"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("lineitem", "l_quantity", "part", "p_size"),
]
COVERED = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders_orphan", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"),
]
FOCUS = ["orders.o_orderkey", "c_custkey"]


def _found(spark, sf, names=ALL):
    return r.relationships(i.tables(spark, sf, names))


def _relationships(spark, sf):
    return i.rounded(_found(spark, sf), 6, "match_rate")


def _cross_source(spark, sf):
    sources = {s: i.tables(spark, sf, names) for s, names in SOURCES.items()}
    return i.rounded(r.cross_source_relationships(sources), 6, "match_rate")


def _key_like(spark, sf):
    tables = i.tables(spark, sf, ALL)
    counts = column_overview(tables).select("table_name", "column_name", "distinct_count")
    keys = r.key_like_columns(table_schema(spark, tables))
    return keys.join(counts, ["table_name", "column_name"])


def _value_overlap(spark, sf):
    out = []
    for s, sc, t, tc in OVERLAPS:
        pair = r.value_overlap(i.table(spark, sf, s), sc, i.table(spark, sf, t), tc)
        out.append(pair.select(F.lit(f"{s}.{sc}->{t}.{tc}").alias("pair"), "*"))
    return i.rounded(i.union(out), 6, "match_rate")


def _approx_overlap(spark, sf):
    """Whether estimates from stored sketches are within their bound of the exact overlap."""
    tables = i.tables(spark, sf, ALL)
    sketches = settle(column_sketches(tables), work_folder(spark), "sketches")
    pair = ["source_table", "source_column", "target_table", "target_column"]
    estimates = approx_overlaps(sketches, sketches).select(
        *pair, F.col("overlap_count").alias("estimate"), "overlap_error"
    )
    within = F.abs(F.col("estimate") - F.col("overlap_count")) <= F.col("overlap_error")
    exact = r.relationships(tables, min_rate=0.0)
    return exact.join(estimates, pair, "left").select(
        *pair, "overlap_count", F.coalesce(within, F.lit(False)).alias("within_bound")
    )


def _edges(spark, sf):
    return i.rounded(r.graph_edges(_found(spark, sf)), 6, "match_rate")


def _joins(spark, sf):
    return i.rounded(r.join_opportunities(_found(spark, sf)), 6, "match_rate")


def _priority(spark, sf):
    tables = i.tables(spark, sf, ALL)
    keys = r.key_like_columns(table_schema(spark, tables))
    return i.rounded(r.touching(r.relationships(tables), keys), 6, "match_rate")


def _priority_nodes(spark, sf):
    return r.graph_nodes(r.touching_names(_found(spark, sf), FOCUS))


def _coverage(spark, sf):
    out = []
    for s, sc, t, tc in COVERED:
        pair = r.join_coverage(i.table(spark, sf, s), sc, i.table(spark, sf, t), tc)
        out.append(pair.select(F.lit(f"{s}.{sc}->{t}.{tc}").alias("pair"), "*"))
    return i.union(out)


QUERIES = {
    "key_like_columns": _key_like,
    "value_overlap": _value_overlap,
    "approx_value_overlap": _approx_overlap,
    "relationships": _relationships,
    "cross_source_relationships": _cross_source,
    "graph_nodes": lambda spark, sf: r.graph_nodes(_found(spark, sf)),
    "graph_edges": _edges,
    "join_opportunities": _joins,
    "priority_relationships": _priority,
    "priority_graph_nodes": _priority_nodes,
    "join_coverage": _coverage,
}


def _key_sql(table: str, c: str) -> str:
    dtype = i.SCHEMAS[table][c]
    if dtype == "double":
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    if dtype == "timestamp_ntz":
        return f"CAST(epoch_us({c}) AS VARCHAR)"
    if dtype == "string":
        return c
    return f"CAST({c} AS VARCHAR)"


def relation_ctes(groups: list[tuple[str, list[str]]], min_rate: float, strong: float, kinds, cross) -> list[str]:
    """``rel``: relationships between groups (sources) or, with one table each, tables."""
    columns = []
    for g, (prefix, names) in enumerate(groups):
        for t in names:
            for c, dtype in i.SCHEMAS[t].items():
                if i.FAMILY[dtype] != "other":
                    columns.append((len(columns), g, f"{prefix}{t}", t, c, i.FAMILY[dtype]))
    values = i.union_sql(
        [
            f"SELECT DISTINCT {k} AS id, {g} AS grp, '{kind}' AS family, {_key_sql(t, c)} AS key "
            f"FROM {t} WHERE {c} IS NOT NULL"
            for k, g, _, t, c, kind in columns
        ]
    )
    cols = ", ".join(f"({k}, {g}, '{name}', '{c}', '{kind}')" for k, g, name, _, c, kind in columns)
    return [
        f"vals AS MATERIALIZED ({values})",
        f"cols(id, grp, table_name, column_name, family) AS (VALUES {cols})",
        "sizes AS (SELECT id, count(*) AS size FROM vals GROUP BY id)",
        """shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM vals a JOIN vals b
          ON a.family = b.family AND a.key = b.key AND a.grp < b.grp GROUP BY 1, 2)""",
        f"""rel AS (SELECT *, CASE WHEN source_unique = 0 OR target_unique = 0 THEN 'low'
            WHEN match_rate >= 0.95 THEN 'high' WHEN match_rate >= 0.7 THEN 'medium'
            WHEN match_rate >= 0.3 THEN 'low' ELSE 'very_low' END AS confidence,
          CASE WHEN match_rate >= {strong} THEN '{kinds[0]}' ELSE '{kinds[1]}' END AS type,
          {cross} AS cross_source
        FROM (SELECT a.table_name AS source_table, a.column_name AS source_column,
            b.table_name AS target_table, b.column_name AS target_column,
            coalesce(o.n, 0) / greatest(coalesce(x.size, 0), 1) AS match_rate,
            coalesce(o.n, 0) AS overlap_count, coalesce(x.size, 0) AS source_unique,
            coalesce(y.size, 0) AS target_unique
          FROM cols a JOIN cols b ON a.family = b.family AND a.grp < b.grp
          LEFT JOIN shared o ON o.a = a.id AND o.b = b.id
          LEFT JOIN sizes x ON x.id = a.id LEFT JOIN sizes y ON y.id = b.id)
        WHERE match_rate >= {min_rate} OR regexp_matches(lower(source_column), '{KEY_PATTERN}'))""",
    ]


def within_ctes(names: list[str], min_rate: float = 0.3) -> list[str]:
    kinds = ("foreign_key", "foreign_key_candidate")
    return relation_ctes([("", [t]) for t in names], min_rate, 0.95, kinds, "false")


def _within(body: str, names=ALL, min_rate: float = 0.3) -> str:
    return i.with_inputs(names, body, *within_ctes(names, min_rate))


_REL = (
    "SELECT source_table, source_column, target_table, target_column, "
    "round(match_rate, 6) AS match_rate, overlap_count, source_unique, target_unique, "
    "confidence, type, cross_source FROM rel"
)


def _overlap_select(s, sc, t, tc):
    return f"""SELECT '{s}.{sc}->{t}.{tc}' AS pair, round(n / a, 6) AS match_rate,
      n AS overlap_count, a AS source_unique, b AS target_unique,
      CASE WHEN n / a >= 0.95 THEN 'high' WHEN n / a >= 0.7 THEN 'medium'
        WHEN n / a >= 0.3 THEN 'low' ELSE 'very_low' END AS confidence
      FROM (SELECT count(DISTINCT {sc}) AS a,
        count(DISTINCT {sc}) FILTER ({sc} IN (SELECT {tc} FROM {t})) AS n FROM {s}),
        (SELECT count(DISTINCT {tc}) AS b FROM {t})"""


def _coverage_select(s, sc, t, tc):
    return f"""SELECT '{s}.{sc}->{t}.{tc}' AS pair, (SELECT count(*) FROM {s}) AS source_rows,
      (SELECT count(*) FROM {s} WHERE {sc} IN (SELECT {tc} FROM {t})) AS matched_rows,
      (SELECT count(*) FROM {s} WHERE {sc} NOT IN (SELECT {tc} FROM {t})) AS unmatched_rows,
      (SELECT count(*) FROM {s} a JOIN {t} b ON a.{sc} = b.{tc}) AS joined_rows"""


_FOCUS = ", ".join(f"'{f}'" for f in FOCUS)
_KEYS = f"regexp_matches(lower({{0}}), '{KEY_PATTERN}')"

SQL = {
    "key_like_columns": i.with_inputs(
        ALL,
        "SELECT table_name, column_name, distinct_count FROM overview WHERE "
        + _KEYS.format("column_name"),
        i.overview_cte(ALL),
    ),
    "value_overlap": i.with_inputs(
        ["orders_orphan"], i.union_sql([_overlap_select(*p) for p in OVERLAPS])
    ),
    "approx_value_overlap": _within(
        "SELECT source_table, source_column, target_table, target_column, overlap_count, "
        "true AS within_bound FROM rel",
        min_rate=0.0,
    ),
    "relationships": _within(_REL),
    "cross_source_relationships": i.with_inputs(
        [],
        _REL,
        *relation_ctes(
            [(f"{s}.", names) for s, names in SOURCES.items()],
            0.2, 0.7, ("foreign_key_candidate", "possible_relationship"), "true",
        ),
    ),
    "graph_nodes": _within(
        "SELECT id, id AS label FROM (SELECT source_table AS id FROM rel "
        "UNION SELECT target_table FROM rel)"
    ),
    "graph_edges": _within(
        "SELECT source_table AS source, target_table AS target, source_column, target_column, "
        "round(match_rate, 6) AS match_rate, confidence, type FROM rel"
    ),
    "join_opportunities": _within(
        "SELECT source_table, target_table, source_column AS join_column_source, "
        "target_column AS join_column_target, round(match_rate, 6) AS match_rate, confidence, "
        "'SELECT * FROM ' || source_table || ' s JOIN ' || target_table || ' t ON s.' || "
        "source_column || ' = t.' || target_column AS suggested_sql FROM rel WHERE match_rate >= 0.7"
    ),
    "priority_relationships": _within(
        f"{_REL} WHERE {_KEYS.format('source_column')} OR {_KEYS.format('target_column')}"
    ),
    "priority_graph_nodes": _within(
        f"""SELECT id, id AS label FROM (SELECT unnest([source_table, target_table]) AS id FROM rel
        WHERE source_table || '.' || source_column IN ({_FOCUS})
          OR target_table || '.' || target_column IN ({_FOCUS})
          OR source_column IN ({_FOCUS}) OR target_column IN ({_FOCUS})) GROUP BY id"""
    ),
    "join_coverage": i.with_inputs(
        ["orders_orphan"], i.union_sql([_coverage_select(*p) for p in COVERED])
    ),
}
