"""Reading tables and their metadata; writing findings."""

from tablescout.sources.folders import read_sources
from tablescout.sources.sinks import insight_lines, read_findings, write_findings, write_lines
from tablescout.sources.tables import (
    approx_cardinality,
    folder_tables,
    head_sample,
    list_tables,
    load_catalog,
    load_folder,
    read_csv,
    table_metadata,
    table_schema,
    table_stats,
)

__all__ = [
    "approx_cardinality",
    "folder_tables",
    "head_sample",
    "insight_lines",
    "list_tables",
    "load_catalog",
    "load_folder",
    "read_csv",
    "read_findings",
    "read_sources",
    "table_metadata",
    "table_schema",
    "table_stats",
    "write_findings",
    "write_lines",
]
