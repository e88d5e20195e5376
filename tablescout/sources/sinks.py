"""Sinks: findings are plain tables, so they are written and read as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_findings(
    findings: dict[str, DataFrame], folder: str, fmt: str = "parquet", by_table: bool = False
) -> list[str]:
    """Write each findings table below ``folder`` as parquet or json; returns the paths."""
    paths = []
    for name, df in findings.items():
        path = f"{folder}/{name}"
        writer = df.write.mode("overwrite").format(fmt)
        if by_table and "table_name" in df.columns:
            writer = writer.partitionBy("table_name")
        writer.save(path)
        paths.append(path)
    return paths


def read_findings(
    spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    return {n: spark.read.format(fmt).load(f"{folder}/{n}") for n in names}


def insight_lines(insights: DataFrame) -> DataFrame:
    """One Markdown bullet per insight, best first when written out in ``rank`` order."""
    line = F.format_string("- %s (score %.2f)", F.col("title"), F.col("score"))
    return insights.select("rank", line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``line`` as text in ``rank`` order."""
    lines.orderBy("rank").select("line").write.mode("overwrite").text(path)
