"""Named queries over the given tables, each with the SQL that must return the same rows."""

from __future__ import annotations

from tablescout.queries import (
    correlations,
    distributions,
    insights,
    kpis,
    profiling,
    relationships,
    sampling,
    scans,
    trends,
    validation,
)

_MODULES = [
    scans,
    sampling,
    profiling,
    correlations,
    validation,
    relationships,
    trends,
    kpis,
    insights,
    distributions,
]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
