"""SQL text for wide projections.

A projection over all columns of a table has hundreds of expressions. Handing Spark one text
instead of building each expression by calls into the JVM keeps planning time short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_rows(rows: list[dict[str, str]]) -> Column:
    """One output row per dict of name to SQL expression; all dicts have the same names."""
    structs = [
        "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in row.items()) + ")"
        for row in rows
    ]
    return F.expr(f"inline(array({', '.join(structs)}))")


def label_of(index: str, names: list[str]) -> Column:
    """The name at a zero-based position held by a column."""
    return F.expr(f"get(array({', '.join(literal(n) for n in names)}), {index})")


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return literal(value)
    if isinstance(value, float):
        return f"'{value!r}'"
    if isinstance(value, list):
        return f"array({', '.join(_text(v) for v in value)})"
    return str(value)


def local_frame(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A frame of schema-sized facts as an inline table.

    The planner knows its exact size, unlike that of a frame built from Python rows, so joins
    with it are broadcast by size without a hint.
    """
    fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
    if not rows:
        return spark.createDataFrame([], T.StructType(fields))
    types = [f.dataType.simpleString() for f in fields]
    body = ", ".join(
        "(" + ", ".join(f"CAST({_text(v)} AS {t})" for v, t in zip(row, types)) + ")"
        for row in rows
    )
    names = ", ".join(ident(f.name) for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS facts({names})")
