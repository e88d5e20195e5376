"""Type families: every operator decides what applies to a column from its declared type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, DATETIME, TEXT, BOOLEAN, OTHER = "numeric", "datetime", "text", "boolean", "other"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_TEXTS = (T.StringType, T.CharType, T.VarcharType)


def family(data_type: T.DataType) -> str:
    if isinstance(data_type, _INTEGRAL + _FRACTIONAL + (T.DecimalType,)):
        return NUMERIC
    if isinstance(data_type, _TIMES):
        return DATETIME
    if isinstance(data_type, _TEXTS):
        return TEXT
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL) or (
        isinstance(data_type, T.DecimalType) and data_type.scale == 0
    )


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, _FRACTIONAL)


def col(name: str) -> Column:
    """Column reference by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def names_of(df: DataFrame, *families: str) -> list[str]:
    """Names of the columns in the given families, in schema order."""
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere: turn it into NULL for float and double columns."""
    fixed = {
        f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if is_fractional(f.dataType)
    }
    return df.withColumns(fixed) if fixed else df


def union_all(
    frames: list[DataFrame], tables: dict[str, DataFrame] | None = None, schema: str = ""
) -> DataFrame:
    """Concatenate frames that share a schema.

    Where no table has a column of the wanted kind there are no frames: the result is then an
    empty frame of ``schema`` in the session of ``tables``.
    """
    if not frames and tables:
        return next(iter(tables.values())).sparkSession.createDataFrame([], schema)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def micros_sql(value: str, kind: T.DataType) -> str:
    """A date or time as microseconds; for a zone-free one without the session's zone."""
    if isinstance(kind, T.TimestampType):
        return f"unix_micros({value})"
    days = f"CAST(unix_date(CAST({value} AS DATE)) AS BIGINT) * 86400000000"
    if isinstance(kind, T.DateType):
        return days
    clock = f"(hour({value}) * 60 + minute({value})) * 60000000L"
    return f"({days} + {clock} + CAST(extract(SECOND FROM {value}) * 1000000 AS BIGINT))"
