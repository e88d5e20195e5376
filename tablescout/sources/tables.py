"""Sources: a source is a ``dict`` of table name to lazy DataFrame."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.sqltext import ident, local_frame
from tablescout.functions.types import col, family, union_all

_SCHEMA = "table_name string, ordinal int, column_name string, dtype string, family string"


def folder_tables(spark: SparkSession, folder: str, extension: str = ".parquet") -> list[str]:
    """Names of the tables below ``folder``, on whatever storage Spark reads it from.

    Found by the paths of their files; no file is opened.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # The name is the path's part that ends with the extension, a file or a directory of files.
    name = F.regexp_extract("path", "([^/]+)" + extension.replace(".", "[.]") + "(/[^/]+)?$", 1)
    found = paths.select(name.alias("name")).where("name <> ''").distinct()
    return sorted(r["name"] for r in found.collect())


def load_folder(
    spark: SparkSession,
    folder: str,
    tables: list[str] | None = None,
    extension: str = ".parquet",
    fmt: str = "parquet",
    **options: str,
) -> dict[str, DataFrame]:
    """Tables stored as one file or directory each below ``folder``; all of them by default.

    ``fmt`` and ``options`` are those of Spark's reader.
    """
    names = folder_tables(spark, folder, extension) if tables is None else sorted(tables)
    reader = spark.read.format(fmt).options(**options)
    return {t: reader.load(f"{folder}/{t}{extension}") for t in names}


def load_catalog(
    spark: SparkSession, database: str, tables: list[str] | None = None
) -> dict[str, DataFrame]:
    """Tables of a catalog database; a requested table that is absent is left out."""
    # Temporary views of the session are listed in every database, but belong to none.
    names = {t.name for t in spark.catalog.listTables(database) if not t.isTemporary}
    wanted = names if tables is None else names & set(tables)
    return {t: spark.table(f"{database}.{t}") for t in sorted(wanted)}


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, corrupt: str | None = None
) -> DataFrame:
    """CSV with a header row; the types are inferred unless a schema is given.

    ``corrupt`` names a text column for lines that do not fit the types; without it their
    cells that do not fit are NULL and nothing tells them from missing ones.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        if corrupt is None:
            return reader.option("inferSchema", True).csv(path)
        # Inference is a scan of its own; the schema that it finds is then read with the column.
        schema = reader.option("inferSchema", True).csv(path).schema.toDDL()
    if corrupt is None:
        return reader.schema(schema).csv(path)
    named = f"{schema}, {ident(corrupt)} STRING"
    return reader.option("columnNameOfCorruptRecord", corrupt).schema(named).csv(path)


def list_tables(
    spark: SparkSession, source: dict[str, DataFrame], requested: list[str] | None = None
) -> DataFrame:
    """Requested tables that exist, or all tables, ordered by name."""
    names = [t for t in sorted(source) if requested is None or t in requested]
    return local_frame(spark, [(t,) for t in names], "table_name string").orderBy("table_name")


def table_schema(spark: SparkSession, source: dict[str, DataFrame]) -> DataFrame:
    """One row per column with its position, declared type and type family. Reads no data."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), family(f.dataType))
        for table, df in source.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return local_frame(spark, rows, _SCHEMA)


def table_metadata(spark: SparkSession, source: dict[str, DataFrame]) -> DataFrame:
    """Columns of each table beside its row count, which parquet answers from the footers."""
    counts = union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(t).alias("table_name"), "row_count"
            )
            for t, df in source.items()
        ]
    )
    # Both sides hold one row per table or column, so the planner broadcasts by size.
    return table_schema(spark, source).join(counts, "table_name")


def _as_given(file: str) -> str:
    """The path that a reader takes for a file's URI: no escapes of a URI, and no pattern in it."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(file))


def table_stats(source: dict[str, DataFrame]) -> DataFrame:
    """Rows, bytes, files and last change of file-backed tables.

    Files are counted as they are listed, with or without rows; none is opened for it.
    """
    parts = []
    for table, df in source.items():
        rows = df.agg(F.count(F.lit(1)).alias("row_count"))
        listed = df.sparkSession.read.format("binaryFile").load([_as_given(f) for f in df.inputFiles()])
        files = listed.select("path", "length", "modificationTime").agg(
            F.sum("length").alias("bytes"),
            F.count(F.lit(1)).alias("files"),
            F.max("modificationTime").alias("last_altered"),
        )
        # One row each.
        parts.append(rows.crossJoin(files).select(F.lit(table).alias("table_name"), "*"))
    return union_all(parts)


def approx_cardinality(
    source: dict[str, DataFrame], columns: list[tuple[str, str]], rsd: float = 0.05
) -> DataFrame:
    """Sketch-based distinct count of ``(table, column)`` pairs; one scan per table."""
    by_table: dict[str, list[str]] = {}
    for table, column in columns:
        by_table.setdefault(table, []).append(column)
    parts = []
    for table, names in by_table.items():
        wide = source[table].agg(
            *[F.approx_count_distinct(col(c), rsd).alias(f"d{i}") for i, c in enumerate(names)]
        )
        rows = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.col(f"d{i}").alias("approx_distinct"),
            )
            for i, c in enumerate(names)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return union_all(parts)


def head_sample(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, in the given order when one is asked for (a top-n, not a full sort)."""
    return df.limit(n) if order_by is None else df.orderBy(*order_by).limit(n)
