"""Column profiles from stored states of files: only files that changed are scanned again.

The state of a file holds, per column, what merges: counts, extremes, mean and squared
deviations, a quantile sketch and a distinct sketch. States are kept as Parquet rows keyed by
path, change time and length. A later profile scans the files without a state, appends theirs,
and merges the states of the files that are there now; states of files that are gone or were
replaced match no file and are left out. The work of a profile grows with what changed.
"""

from __future__ import annotations

from math import ceil
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.sqltext import ident, inline_rows, label_of
from tablescout.functions.types import DATETIME, NUMERIC, OTHER, TEXT, family, is_fractional
from tablescout.operators.profile import TIME_FORMAT
from tablescout.operators.sketches import FAN, SKETCH_K, quantiles_sql

HLL_BITS = 12
FORM = 2  # of the states; those of other forms do not merge with them
FILE = ["file", "changed", "length"]
#: What is stored of a column in a file, with its SQL text where it does not apply.
PARTS = {
    "present": "bigint", "min": "double", "max": "double", "mean": "double", "m2": "double",
    "min_time": "string", "max_time": "string", "sketch": "binary", "hll": "binary",
}
STATE = (
    "run string, form int, file string, changed timestamp, length bigint, rows bigint, ordinal int, "
    + ", ".join(f"{name} {kind}" for name, kind in PARTS.items())
)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, file, changed, length)`` of the files below ``folder``; none is opened.

    ``path`` is as a reader takes it, ``file`` as rows tell where they are from.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(
        "path",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("changed"),
        F.col("_metadata.file_size").alias("length"),
    )


def stored_states(spark: SparkSession, store: str) -> DataFrame:
    """All states of this form written so far; none where the store does not exist yet."""
    try:
        return spark.read.schema(STATE).parquet(store).where(F.col("form") == FORM)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def _inputs(field: T.StructField) -> dict[str, str]:
    """SQL text of what the aggregates of a column read: value, number, hash."""
    c, kind = ident(field.name), family(field.dataType)
    if is_fractional(field.dataType):
        c = f"nanvl({c}, CAST(NULL AS {field.dataType.simpleString()}))"
    out = {"d": f"CAST({c} AS DOUBLE)"} if kind == NUMERIC else {"v": c}
    if kind != OTHER:
        # The null test stays outside: a hash of NULL is a value.
        out["h"] = f"if({c} IS NULL, NULL, xxhash64({c}))"
    return out


def _state(kind: str, names: dict[str, str], k: int) -> dict[str, str]:
    """SQL text of what is aggregated of one column, over the names of its inputs."""
    out = {}
    if kind == NUMERIC:
        d = names["d"]
        out = {"mean": f"avg({d})", "m2": f"var_pop({d})", "sketch": f"kll_sketch_agg_double({d}, {k})"}
    else:
        out["present"] = f"count({names['v']})"
    if kind == DATETIME:
        out |= {f"{m}_time": f"date_format({m}({names['v']}), '{TIME_FORMAT}')" for m in ("min", "max")}
    if kind != OTHER:
        out["hll"] = f"hll_sketch_agg({names['h']}, {HLL_BITS})"
    return out


def _row(i: int, aggregated: dict[str, str]) -> dict[str, str]:
    """SQL text of the stored row of column ``i``.

    A sketch holds the count and both extremes of a number exactly.
    """
    out = {name: f"CAST(NULL AS {t})" for name, t in PARTS.items()}
    out |= {name: f"_{name}_{i}" for name in aggregated}
    if "sketch" in aggregated:
        out["present"] = f"kll_sketch_get_n_double(_sketch_{i})"
        for name, place in (("min", 0.0), ("max", 1.0)):
            out[name] = quantiles_sql(f"_sketch_{i}", out["present"], [place]) + "[0]"
        out["m2"] = f"_m2_{i} * {out['present']}"
    return {"ordinal": str(i), **out}


def file_states(df: DataFrame, run: str, k: int = SKETCH_K) -> DataFrame:
    """States of the files that ``df`` reads: one row per file and column, from one scan.

    Sketches evaluate their inputs one by one, row by row; so these are columns of a projection,
    which runs as generated code.
    """
    inputs, aggregates, rows = [], ["count(1) AS _rows"], []
    for i, field in enumerate(df.schema.fields):
        read = _inputs(field)
        inputs += [f"{sql} AS _{name}_{i}" for name, sql in read.items()]
        stored = _state(family(field.dataType), {name: f"_{name}_{i}" for name in read}, k)
        aggregates += [f"{sql} AS _{name}_{i}" for name, sql in stored.items()]
        rows.append(_row(i, stored))
    by_file = df.select(F.col("_metadata").alias("_m"), "*").selectExpr(
        "_m.file_path AS file", "_m.file_modification_time AS changed", "_m.file_size AS length", *inputs
    )
    states = by_file.groupBy(*FILE).agg(*[F.expr(a) for a in aggregates])
    return states.select(
        F.lit(run).alias("run"), F.lit(FORM).alias("form"), *FILE, F.col("_rows").alias("rows"), inline_rows(rows)
    )


def _united(states: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Merged states; ``shift`` and ``square`` are the moments of the file means about one place."""
    sums = ["rows", "scanned", "present", "shift", "square", "m2"]
    return states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in ("min", "min_time")],
        *[F.max(c).alias(c) for c in ("max", "max_time")],
        F.expr(f"kll_merge_agg_double(sketch, {k})").alias("sketch"),
        F.expr("hll_union_agg(hll)").alias("hll"),
    )


def incremental_profile(
    spark: SparkSession,
    folder: str,
    store: str,
    fmt: str = "parquet",
    k: int = SKETCH_K,
    fan: int = FAN,
) -> DataFrame:
    """One row per column of the table in ``folder``, from stored states and a scan of the rest.

    Columns: column_name, dtype, row_count, scanned_rows (read this time), null_count, min, max,
    mean, std, p50 (within the sketch's error), approx_distinct, min_time, max_time. NaN counts
    as missing. Names of folders give no columns. The states are of the schema that the files
    have now; where it changes, use another ``store``. The paths of the files to scan reach the
    driver, as they do for any reader.
    """
    files = files_of(spark, folder)
    known = stored_states(spark, store).select(*FILE).distinct()
    fresh = [r["path"] for r in files.join(known, FILE, "left_anti").select("path").collect()]
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true")
    schema = reader.load(folder).schema
    run = uuid4().hex
    if fresh:
        file_states(reader.schema(schema).load(fresh), run, k).write.mode("append").parquet(store)
    # A file scanned by two runs at once has two equal states.
    states = stored_states(spark, store).join(files, FILE, "left_semi")
    states = states.dropDuplicates([*FILE, "ordinal"])
    # Means are united about one of them: squares of what is left lose no digits.
    places = states.groupBy("ordinal").agg(F.min("mean").alias("place"))
    states = states.join(F.broadcast(places), "ordinal").withColumns(
        {
            "scanned": F.when(F.col("run") == run, F.col("rows")).otherwise(F.lit(0)),
            "shift": F.expr("present * (mean - place)"),
            "square": F.expr("present * (mean - place) * (mean - place)"),
        }
    )
    # No task unites the states of more than about ``fan`` files, or groups of them.
    nodes = max(1, ceil(files.count() / fan))
    states = states.withColumn("_node", F.pmod(F.xxhash64("file"), F.lit(nodes)))
    states = _united(states, ["ordinal", "_node"], k)
    while nodes > 1:
        nodes = ceil(nodes / fan)
        states = states.withColumn("_node", F.col("_node") % nodes)
        states = _united(states, ["ordinal", "_node"], k)
    whole = states.join(F.broadcast(places), "ordinal")
    deviations = "greatest(m2 + square - shift * shift / present, 0D)"
    spread = f"if(present > 1, sqrt({deviations} / (present - 1)), 0D)"
    numeric = "max IS NOT NULL"
    return whole.select(
        label_of("ordinal", schema.names).alias("column_name"),
        label_of("ordinal", [f.dataType.simpleString() for f in schema.fields]).alias("dtype"),
        F.col("rows").alias("row_count"),
        F.col("scanned").alias("scanned_rows"),
        F.expr("rows - present").alias("null_count"),
        "min",
        "max",
        F.expr(f"if({numeric}, place + shift / present, NULL)").alias("mean"),
        F.expr(f"if({numeric}, {spread}, NULL)").alias("std"),
        F.expr(quantiles_sql("sketch", "kll_sketch_get_n_double(sketch)", [0.5]))[0].alias("p50"),
        F.expr("hll_sketch_estimate(hll)").alias("approx_distinct"),
        "min_time",
        "max_time",
    )
