"""A table that several sources hold, as one Spark data source.

``spark.read.format("tablescout")`` reads the Parquet files of one table below several named
folders, with the name of the source beside each row. Files are cut into partitions by bytes; no
footer is opened on the driver but one for the schema. Filters on the source's name leave out
whole partitions, filters on integers, texts and booleans leave out row groups by their
statistics and rows before they reach Spark. Spark hands no column list to such a source, so the
columns to read are an option. Folders are local paths or addresses that pyarrow can open.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as d
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

FORMAT = "tablescout"
SOURCE_NAME = "source_name"
SPLIT_BYTES = 128 << 20
BATCH_ROWS = 1024

# Values of these types compare in Arrow as they do in Spark; NaN and time zones do not.
_COMPARED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType)
_ORDERED = {
    d.GreaterThan: operator.gt,
    d.GreaterThanOrEqual: operator.ge,
    d.LessThan: operator.lt,
    d.LessThanOrEqual: operator.le,
    d.EqualTo: operator.eq,
}


@dataclass
class FilePart(d.InputPartition):
    """The row groups of a file that begin within a range of its bytes."""

    source: str
    path: str
    begin: int
    end: int


def _files(folder: str, table: str, extension: str) -> list[fs.FileInfo]:
    """The table's file, or the files of its folder that are not hidden; none where it is absent."""
    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    info = system.get_file_info(f"{root.rstrip('/')}/{table}{extension}")
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(info.path, recursive=True, allow_not_found=True))
    return [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size]


def _system(folder: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()


def _matches(rule: d.Filter, name: str) -> bool:
    """Whether a source of this name can hold rows that the rule accepts."""
    if isinstance(rule, d.EqualTo):
        return name == rule.value
    if isinstance(rule, d.In):
        return name in rule.value
    return True


class FolderReader(d.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.folders = schema, json.loads(options["folders"])
        self.table, self.extension = options["table"], options.get("extension", ".parquet")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.named: list[d.Filter] = []
        self.rules: list[d.Filter] = []

    def pushFilters(self, filters: list[d.Filter]) -> Iterable[d.Filter]:
        """Keeps the filters that partitions and scans apply in full; the others are Spark's."""
        for rule in filters:
            column = getattr(rule, "attribute", ())
            if column == (SOURCE_NAME,) and isinstance(rule, (d.EqualTo, d.In, d.IsNotNull)):
                self.named.append(rule)
            elif (
                len(column) == 1
                and column[0] in self.schema.names
                and column[0] != SOURCE_NAME
                and isinstance(self.schema[column[0]].dataType, _COMPARED)
                and isinstance(rule, (*_ORDERED, d.In, d.IsNotNull))
            ):
                self.rules.append(rule)
            else:
                yield rule

    def partitions(self) -> list[FilePart]:
        out = []
        for name, folder in self.folders.items():
            if all(_matches(rule, name) for rule in self.named):
                for file in _files(folder, self.table, self.extension):
                    for begin in range(0, file.size, self.split):
                        out.append(FilePart(name, file.path, begin, begin + self.split))
        return out

    def _expression(self) -> pc.Expression | None:
        parts = []
        for rule in self.rules:
            field = ds.field(rule.attribute[0])
            if isinstance(rule, d.IsNotNull):
                parts.append(field.is_valid())
            elif isinstance(rule, d.In):
                # As Spark: a null in the list accepts nothing that the other values do not.
                parts.append(field.isin([v for v in rule.value if v is not None]))
            else:
                value = pa.scalar(rule.value, to_arrow_schema(self.schema).field(rule.attribute[0]).type)
                parts.append(_ORDERED[type(rule)](field, value))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        system = _system(self.folders[partition.source])
        whole = to_arrow_schema(self.schema)
        held = pa.schema([f for f in whole if f.name != SOURCE_NAME])
        footer = pq.read_metadata(partition.path, filesystem=system)
        groups = [
            g
            for g in range(footer.num_row_groups)
            if partition.begin <= _place(footer.row_group(g)) < partition.end
        ]
        if not groups:
            return
        wanted = self._expression()
        fragment = ds.ParquetFileFormat().make_fragment(partition.path, system, row_groups=groups)
        scan = fragment.scanner(
            schema=held, filter=wanted, batch_size=BATCH_ROWS, batch_readahead=1, fragment_readahead=1,
            use_threads=False,
        )
        for batch in scan.to_batches():
            if batch.num_rows:
                names = pa.array([partition.source] * batch.num_rows, pa.string())
                held_columns = dict(zip(held.names, batch.columns, strict=True)) | {SOURCE_NAME: names}
                columns = [held_columns[f.name].cast(f.type) for f in whole]
                yield pa.RecordBatch.from_arrays(columns, schema=whole)


def _place(group: pq.RowGroupMetaData) -> int:
    """Where a row group begins in its file; one without columns counts as its file's first."""
    starts = [
        c.data_page_offset if c.dictionary_page_offset is None else c.dictionary_page_offset
        for c in (group.column(k) for k in range(group.num_columns))
    ]
    return min(starts, default=0)


class FolderSource(d.DataSource):
    """Options: ``folders`` (JSON, name to folder), ``table``, ``columns`` (JSON list),
    ``extension`` and ``splitBytes``. A source without the table gives no rows. A column of the
    table with the name ``source_name`` gives way to that of the source."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        options = self.options
        for folder in json.loads(options["folders"]).values():
            for file in _files(folder, options["table"], options.get("extension", ".parquet")):
                found = pq.read_schema(file.path, filesystem=_system(folder))
                if "columns" in options:
                    found = pa.schema([found.field(c) for c in json.loads(options["columns"])])
                held = from_arrow_schema(found, prefer_timestamp_ntz=True).fields
                held = [f for f in held if f.name.lower() != SOURCE_NAME]
                return T.StructType([*held, T.StructField(SOURCE_NAME, T.StringType())])
        raise FileNotFoundError(f"no source holds the table {options['table']}")

    def reader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(schema, dict(self.options))


def read_sources(
    spark: SparkSession,
    folders: dict[str, str],
    table: str,
    columns: list[str] | None = None,
    schema: T.StructType | str | None = None,
    extension: str = ".parquet",
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """The rows of ``table`` in all ``folders`` (name to folder), with ``source_name``.

    The schema is that of the first file found, unless it is given with ``source_name`` in it;
    a column that other files lack is null there. Registers the format with the session and lets
    it hand filters to Python sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    reader = spark.read.format(FORMAT).option("folders", json.dumps(folders)).option("table", table)
    reader = reader.option("extension", extension).option("splitBytes", str(split_bytes))
    if columns is not None:
        reader = reader.option("columns", json.dumps(columns))
    return (reader if schema is None else reader.schema(schema)).load()
