"""The whole exploration of one source, or of several, as a dict of findings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.local import pin, settle, work_folder
from tablescout.functions.types import NUMERIC, names_of
from tablescout.operators.correlate import column_correlates, pearson, spearman
from tablescout.operators.insights import (
    column_priority,
    correlation_insights,
    missingness_insights,
    organize_tasks,
    overview_stats,
    rank_insights,
    task_summary,
    top_priority_columns,
)
from tablescout.operators.kpi import kpi_suggestions, kpi_summary
from tablescout.operators.profile import column_overview, table_profile, top_values
from tablescout.operators.quantiles import column_quantiles
from tablescout.operators.relate import (
    cross_source_relationships,
    graph_edges,
    graph_nodes,
    join_opportunities,
    relationships,
)
from tablescout.operators.trends import trend_batch
from tablescout.operators.validate import validation_report, validation_summary
from tablescout.sources.sinks import insight_lines, write_findings, write_lines

QUANTILES = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def explore(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    found: DataFrame | None = None,
    top_columns: int = 10,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Every analysis of one source. ``found`` replaces the relationships within the source.

    Findings that others build on are computed once and kept in ``folder``, by default below
    the session's checkpoint folder.
    """
    folder = work_folder(spark) if folder is None else folder

    def once(name: str, df: DataFrame) -> DataFrame:
        return settle(df, folder, name)

    overview = pin(column_overview(tables))
    profile = once("table_profile", table_profile(tables))
    numeric = {t: df for t, df in tables.items() if len(names_of(df, NUMERIC)) > 1}
    correlations = once("pearson", pearson(numeric or tables))
    found = once("relationship", relationships(tables) if found is None else found)
    report = once("validation", validation_report(tables, stats=overview, profile=profile))
    kpis = once("kpi", kpi_suggestions(tables, overview))
    insights = rank_insights(
        missingness_insights(overview).unionByName(correlation_insights(correlations))
    )
    priority = once("column_priority", column_priority(overview, insights, kpis, found))
    chosen = [
        (r["table_name"], r["column_name"])
        for r in top_priority_columns(priority, top_columns).collect()
    ]
    trends, failures = trend_batch(spark, tables, chosen, overview, kpis)
    tasks = once("task", organize_tasks(insights, found, report, kpis))
    return {
        "table_profile": profile,
        "column_overview": overview,
        "column_quantiles": column_quantiles(tables, QUANTILES),
        "top_values": top_values(tables),
        "correlation": correlations.unionByName(spearman(numeric or tables)),
        "column_correlates": column_correlates(correlations),
        "validation": report,
        "validation_summary": validation_summary(report),
        "relationship": found,
        "graph_nodes": graph_nodes(found),
        "graph_edges": graph_edges(found),
        "join_opportunities": join_opportunities(found),
        "kpi": kpis,
        "kpi_summary": kpi_summary(kpis),
        "insight": insights,
        "column_priority": priority,
        "trend": trends,
        "trend_failure": failures,
        "task": tasks,
        "task_summary": task_summary(tasks),
        "overview": overview_stats(overview, report, insights),
    }


def explore_sources(
    spark: SparkSession, sources: dict[str, dict[str, DataFrame]], top_columns: int = 10
) -> dict[str, DataFrame]:
    """Several sources at once: one analysis over all tables, named ``source.table``.

    Relationships are those within each source and those across sources.
    """
    tables = {f"{s}.{t}": df for s, members in sources.items() for t, df in members.items()}
    found = cross_source_relationships(sources)
    for s, members in sources.items():
        if len(members) > 1:
            found = found.unionByName(
                relationships({f"{s}.{t}": df for t, df in members.items()})
            )
    return explore(spark, tables, found, top_columns)


def write_exploration(findings: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write every findings table, and the insights as Markdown lines."""
    write_findings(findings, folder, fmt)
    lines = insight_lines(findings["insight"].select("rank", "title", F.col("score")))
    write_lines(lines, f"{folder}/insights_md")
