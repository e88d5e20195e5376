"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(_cell(r[k]) for k in order) for r in rows]
    return sorted(out, key=lambda r: tuple((c is None, str(type(c)), str(c)) for c in r))


def spark_rows(df):
    return sorted(df.columns), canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(names), canonical(names, result.fetchall())
