"""Inputs of the registered queries: the given tables and inputs derived from them.

The given tables hold no missing values, booleans, repeated rows or mixed texts, so inputs
with those are derived by the same expressions in Spark and in SQL. Every derived input grows
with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.text import (
    BLANK_PATTERN,
    ISO_DATE_PATTERN,
    KEY_PATTERN,
    NUMBER_PATTERN,
)
from tablescout.functions.types import union_all

# Column types of the given and the derived tables.
SCHEMAS: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {
        "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "supplier": {
        "s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double",
    },
    "part": {
        "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
        "p_size": "int", "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
        "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
        "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
        "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
        "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
        "value": "double", "props": "string",
    },
    "documents": {
        "doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
        "n_chars": "bigint",
    },
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {
        "conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string",
    },
    "orders_dirty": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
        "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
        "is_urgent": "boolean",
    },
    "events_mixed": {"event_id": "bigint", "code": "string", "value": "double"},
    "events_text_time": {
        "event_id": "bigint", "event_type": "string", "ts": "string", "value": "double",
    },
    "contacts": {"c_custkey": "bigint", "email": "string", "c_acctbal": "double"},
    "lineitem_corr": {
        "l_quantity": "double", "l_extendedprice": "double", "net_price": "double",
        "constant": "int",
    },
}

GIVEN = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]
PROFILED = GIVEN + ["orders_dirty"]
CORE = ["customer", "events", "lineitem", "orders_dirty", "part"]

FAMILY = {
    "int": "numeric", "bigint": "numeric", "double": "numeric", "string": "text",
    "timestamp_ntz": "datetime", "boolean": "boolean", "array<float>": "other",
}

DERIVED_SQL = {
    "orders_dirty": """
        SELECT o_orderkey, o_custkey,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
          o_orderdate,
          CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '  '
               ELSE o_orderpriority END AS o_orderpriority,
          o_orderpriority = '1-URGENT' AS is_urgent
        FROM (SELECT * FROM orders UNION ALL
              SELECT * FROM orders WHERE o_totalprice > 450000 AND o_orderpriority = '1-URGENT')""",
    "events_mixed": """
        SELECT event_id,
          CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS code,
          value FROM events""",
    "events_text_time": """
        SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS ts, value FROM events""",
    "contacts": """
        SELECT c_custkey, 'user' || c_custkey || '@example.com' AS email, c_acctbal
        FROM customer""",
    "lineitem_corr": """
        SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net_price,
          1 AS constant FROM lineitem""",
    "orders_orphan": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey
        FROM orders""",
    "events_sparse": """
        SELECT ts, event_type, CASE WHEN value >= 90 THEN value END AS value FROM events""",
    "doc_texts": "SELECT text FROM documents",
}


def _derive(name: str, base) -> DataFrame:
    if name == "orders_dirty":
        orders = base("orders")
        again = orders.where("o_totalprice > 450000 AND o_orderpriority = '1-URGENT'")
        key = F.col("o_orderkey")
        return orders.unionAll(again).select(
            "o_orderkey",
            "o_custkey",
            F.when(key % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
            F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
            "o_orderdate",
            F.when(key % 11 == 0, "").when(key % 13 == 0, "  ")
            .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"),
        )
    if name == "events_mixed":
        key = F.col("event_id")
        code = F.when(key % 3 == 0, key.cast("string")).otherwise(F.col("event_type"))
        return base("events").select("event_id", code.alias("code"), "value")
    if name == "events_text_time":
        day = F.date_format("ts", "yyyy-MM-dd").alias("ts")
        return base("events").select("event_id", "event_type", day, "value")
    if name == "contacts":
        email = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
        return base("customer").select("c_custkey", email.alias("email"), "c_acctbal")
    if name == "lineitem_corr":
        net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price")
        return base("lineitem").select(
            "l_quantity", "l_extendedprice", net, F.lit(1).alias("constant")
        )
    if name == "orders_orphan":
        key = F.col("o_custkey")
        moved = F.when(F.col("o_orderkey") % 10 == 0, key + 1000000).otherwise(key)
        return base("orders").select("o_orderkey", moved.alias("o_custkey"))
    if name == "events_sparse":
        kept = F.when(F.col("value") >= 90, F.col("value")).alias("value")
        return base("events").select("ts", "event_type", kept)
    if name == "doc_texts":
        return base("documents").select("text")
    raise KeyError(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""

    def base(given: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{given}.parquet")

    return _derive(name, base) if name in DERIVED_SQL else base(name)


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def union(frames: list[DataFrame]) -> DataFrame:
    return union_all(frames)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def timed(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as text, so that both engines return the same type."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


# --- SQL text ---------------------------------------------------------------------------


def with_inputs(names: list[str], body: str, *ctes: str) -> str:
    """``body`` with the derived inputs among ``names`` and further ``name AS (...)`` parts."""
    parts = [f"{n} AS ({DERIVED_SQL[n]})" for n in names if n in DERIVED_SQL] + list(ctes)
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def columns_of(names: list[str], *families: str) -> list[tuple[str, str]]:
    return [
        (t, c)
        for t in names
        for c, dtype in SCHEMAS[t].items()
        if not families or FAMILY[dtype] in families
    ]


def union_sql(selects: list[str]) -> str:
    return "\nUNION ALL ".join(selects)


def percent_sql(part: str, whole: str) -> str:
    """One-decimal percent text."""
    tenths = (
        f"CAST(CASE WHEN ({whole}) = 0 THEN 0 ELSE "
        f"floor((({part}) * 2000.0 + ({whole})) / (({whole}) * 2.0)) END AS BIGINT)"
    )
    return f"(({tenths}) // 10) || '.' || (({tenths}) % 10) || '%'"


def _stats_select(t: str, c: str) -> str:
    dtype = SCHEMAS[t][c]
    kind, ordinal = FAMILY[dtype], list(SCHEMAS[t]).index(c)
    number, text = kind == "numeric", kind == "text"
    pairs = [
        (f"'{t}'", "table_name"),
        (f"'{c}'", "column_name"),
        (str(ordinal), "ordinal"),
        (f"'{dtype}'", "dtype"),
        (f"'{kind}'", "family"),
        ("true" if dtype in ("int", "bigint") else "false", "integral"),
        ("count(*)", "row_count"),
        (f"count(*) - count({c})", "null_count"),
        (f"count({c})", "present_count"),
        ("NULL::BIGINT" if kind == "other" else f"count(DISTINCT {c})", "distinct_count"),
        (f"min({c})::DOUBLE" if number else "NULL::DOUBLE", "min_value"),
        (f"max({c})::DOUBLE" if number else "NULL::DOUBLE", "max_value"),
        (f"avg({c}::DOUBLE)" if number else "NULL::DOUBLE", "mean_value"),
        (
            f"CASE WHEN count({c}) > 0 THEN coalesce(stddev_samp({c}::DOUBLE), 0) END"
            if number else "NULL::DOUBLE", "std_value",
        ),
        (f"count(*) FILTER ({c} < 0)" if number else "0", "negative_count"),
        (f"count(*) FILTER ({c} = 0)" if number else "0", "zero_count"),
        (
            f"count(*) FILTER ({c} <> floor({c}))" if dtype == "double" else "0",
            "fraction_count",
        ),
        (f"count(*) FILTER (regexp_matches({c}, '{BLANK_PATTERN}'))" if text else "0", "blank_count"),
        (
            f"count(*) FILTER (contains({c}, '-') OR contains({c}, '/') OR contains({c}, 'T'))"
            if text else "0", "date_like_count",
        ),
        (f"count(*) FILTER (contains({c}, '@'))" if text else "0", "email_like_count"),
        (
            f"count(*) FILTER (regexp_matches({c}, '{NUMBER_PATTERN}'))" if text else "0",
            "number_like_count",
        ),
        (
            f"count(*) FILTER (regexp_matches({c}, '{ISO_DATE_PATTERN}'))" if text else "0",
            "iso_date_count",
        ),
        (f"coalesce(max(length({c})), 0)" if text else "0", "max_length"),
    ]
    return "SELECT " + ", ".join(f"{e} AS {n}" for e, n in pairs) + f" FROM {t}"


ROLE_SQL = """CASE WHEN family <> 'numeric' THEN NULL
  WHEN distinct_count = 0 THEN 'measure'
  WHEN distinct_count / row_count < 0.2
    AND (integral OR fraction_count = 0 OR distinct_count <= 10) THEN 'dimension'
  WHEN integral AND distinct_count / row_count >= 0.2 AND distinct_count / row_count < 0.5
    AND distinct_count > 1 AND max_value - min_value + 1 = distinct_count THEN 'dimension'
  ELSE 'measure' END"""


def overview_cte(names: list[str]) -> str:
    """``overview``: one row per column with counts, moments, pattern counts and role."""
    stats = union_sql([_stats_select(t, c) for t, c in columns_of(names)])
    return f"""overview AS (SELECT *, coalesce(null_count / nullif(row_count, 0), 0) AS null_pct,
      {ROLE_SQL} AS numeric_role FROM ({stats}))"""


def frequency_cte(names: list[str]) -> str:
    """``freq``: counts per distinct value of every text column."""
    return "freq AS (" + union_sql(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, "
            f"count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 3"
            for t, c in columns_of(names, "text")
        ]
    ) + ")"
