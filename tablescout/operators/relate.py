"""Relationships between columns: inclusion of value sets, for all column pairs at once.

All columns of all tables are unpivoted to (family, key) with a bit per column. Grouping by
key and OR-ing the bits yields, per value, the set of columns that hold it; grouping those
sets again leaves a short table of column sets with value counts. Column pairs are formed from
that table only, never per value, and one shuffle of distinct keys serves every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.sqltext import ident, inline_rows, local_frame
from tablescout.functions.text import key_like
from tablescout.functions.types import DATETIME, NUMERIC, TEXT, col, family, micros_sql, nan_to_null, union_all
from tablescout.operators.frequency import COUNTABLE, KEYS

BITS = 62  # columns per bitmap word


def shared_key(field: T.StructField) -> dict[str, str]:
    """Key slots that are equal whenever the values are equal as numbers, texts or times."""
    c, kind = ident(field.name), family(field.dataType)
    slots = {"int_key": "NULL", "float_key": "NULL", "text_key": "NULL"}
    if kind == NUMERIC and isinstance(
        field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)
    ):
        d = f"CAST({c} AS DOUBLE)"
        whole = f"({d} = floor({d}) AND abs({d}) < 9.0e18D)"
        if isinstance(field.dataType, T.DecimalType):
            # A decimal may hold a fraction that its double cannot.
            whole = f"({c} = floor({c}) AND try_cast({c} AS BIGINT) IS NOT NULL)"
        slots["int_key"] = f"if({whole}, try_cast({c} AS BIGINT), NULL)"
        slots["float_key"] = f"if({whole}, NULL, {d})"
    elif kind == DATETIME:
        slots["int_key"] = micros_sql(f"CAST({c} AS TIMESTAMP_NTZ)", T.TimestampNTZType())
    elif kind == TEXT:
        slots["text_key"] = c
    else:
        slots["int_key"] = c
    return {k: f"CAST({slots[k]} AS {t})" for k, t in zip(KEYS, ("BIGINT", "DOUBLE", "STRING"))}


class ColumnSets:
    """Column sets with the number of distinct values each set shares exclusively.

    ``groups`` numbers the tables; columns of one group are not compared with each other.
    """

    def __init__(self, tables: dict[str, DataFrame], groups: dict[str, int]):
        self.spark: SparkSession = next(iter(tables.values())).sparkSession
        self.columns: list[tuple[int, int, str, str, str]] = []
        words_of, parts = {}, []
        for t, df in tables.items():
            for f in df.schema.fields:
                if family(f.dataType) in COUNTABLE:
                    words_of[t, f.name] = len(self.columns)
                    self.columns.append(
                        (len(self.columns), groups[t], t, f.name, family(f.dataType))
                    )
        self.words = max(1, -(-len(self.columns) // BITS))
        for t, df in tables.items():
            rows = []
            for f in df.schema.fields:
                if family(f.dataType) not in COUNTABLE:
                    continue
                i = words_of[t, f.name]
                bits = {
                    f"w{w}": f"{1 << (i % BITS) if i // BITS == w else 0}L"
                    for w in range(self.words)
                }
                kind = str(COUNTABLE.index(family(f.dataType)))
                rows.append({"family": kind, **shared_key(f), **bits})
            if rows:
                parts.append(nan_to_null(df).select(inline_rows(rows)))
        values = union_all(parts).where(
            "int_key IS NOT NULL OR float_key IS NOT NULL OR text_key IS NOT NULL"
        )
        words = [f"w{w}" for w in range(self.words)]
        per_value = values.groupBy("family", *KEYS).agg(
            *[F.bit_or(w).alias(w) for w in words]
        )
        self.sets = per_value.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))

    def members(self) -> DataFrame:
        """``(members array<int>, n)``: column numbers of each set."""
        checks = [f"if(w{i // BITS} & {1 << (i % BITS)}L <> 0, {i}, NULL)" for i, *_ in self.columns]
        members = F.expr(f"array_compact(array({', '.join(checks)}))")
        return self.sets.select(members.alias("members"), "n")

    def catalog(self, side: str) -> DataFrame:
        """One row per column of the tables, its fields prefixed by ``side``."""
        names = ("id", "grp", "table", "column")
        return local_frame(
            self.spark,
            self.columns,
            "id int, grp int, table string, column string, family string",
        ).withColumnsRenamed({n: f"{side}_{n}" for n in names})


def _confidence(rate: Column, either_empty: Column) -> Column:
    return (
        F.when(either_empty, "low")
        .when(rate >= 0.95, "high")
        .when(rate >= 0.7, "medium")
        .when(rate >= 0.3, "low")
        .otherwise("very_low")
    )


def _pairs(sets: ColumnSets, both_directions: bool = False) -> DataFrame:
    """Overlap of all column pairs of one family in different groups, from schema-sized inputs."""
    single = sets.members().select(F.explode("members").alias("id"), "n")
    sizes = single.groupBy("id").agg(F.sum("n").alias("size"))
    both = (
        sets.members()
        .select(F.explode("members").alias("source_id"), "members", "n")
        .select("source_id", F.explode("members").alias("target_id"), "n")
        .groupBy("source_id", "target_id")
        .agg(F.sum("n").alias("overlap_count"))
    )
    order = "source_grp <> target_grp" if both_directions else "source_grp < target_grp"
    grid = (
        sets.catalog("source")
        .join(sets.catalog("target"), "family")
        .where(order)
        .withColumn("key_like", key_like(F.col("source_column")))
    )
    source_size = sizes.select(F.col("id").alias("source_id"), F.col("size").alias("source_unique"))
    target_size = sizes.select(F.col("id").alias("target_id"), F.col("size").alias("target_unique"))
    zero = F.lit(0).cast("bigint")
    out = (
        grid.join(both, ["source_id", "target_id"], "left")
        .join(source_size, "source_id", "left")
        .join(target_size, "target_id", "left")
        .withColumns(
            {c: F.coalesce(c, zero) for c in ("overlap_count", "source_unique", "target_unique")}
        )
    )
    rate = F.coalesce(F.try_divide(F.col("overlap_count"), F.col("source_unique")), F.lit(0.0))
    empty = (F.col("source_unique") == 0) | (F.col("target_unique") == 0)
    return out.withColumn("match_rate", rate).withColumn(
        "confidence", _confidence(F.col("match_rate"), empty)
    )


_RELATIONSHIP = [
    "source_table",
    "source_column",
    "target_table",
    "target_column",
    "match_rate",
    "overlap_count",
    "source_unique",
    "target_unique",
    "confidence",
    "type",
    "cross_source",
]


def relationships(
    tables: dict[str, DataFrame], both_directions: bool = False, min_rate: float = 0.3
) -> DataFrame:
    """Column pairs of different tables whose values overlap or whose source looks like a key.

    Tables are compared in the order given, earlier to later unless ``both_directions``.
    """
    groups = {t: i for i, t in enumerate(tables)}
    pairs = _pairs(ColumnSets(tables, groups), both_directions)
    kind = F.when(F.col("match_rate") >= 0.95, "foreign_key").otherwise("foreign_key_candidate")
    return (
        pairs.where((F.col("match_rate") >= min_rate) | F.col("key_like"))
        .withColumns({"type": kind, "cross_source": F.lit(False)})
        .select(*_RELATIONSHIP)
    )


def cross_source_relationships(
    sources: dict[str, dict[str, DataFrame]], min_rate: float = 0.2
) -> DataFrame:
    """Column pairs of tables in different sources; table names carry their source."""
    tables, groups = {}, {}
    for i, (source, members) in enumerate(sources.items()):
        for t, df in members.items():
            tables[f"{source}.{t}"] = df
            groups[f"{source}.{t}"] = i
    pairs = _pairs(ColumnSets(tables, groups))
    kind = F.when(F.col("match_rate") >= 0.7, "foreign_key_candidate").otherwise(
        "possible_relationship"
    )
    return (
        pairs.where((F.col("match_rate") >= min_rate) | F.col("key_like"))
        .withColumns({"type": kind, "cross_source": F.lit(True)})
        .select(*_RELATIONSHIP)
    )


def value_overlap(
    source: DataFrame, source_column: str, target: DataFrame, target_column: str
) -> DataFrame:
    """Overlap of two columns' distinct values, as one row."""
    pair = {
        "source": source.select(col(source_column).alias("source")),
        "target": target.select(col(target_column).alias("target")),
    }
    return _pairs(ColumnSets(pair, {"source": 0, "target": 1})).select(
        "match_rate", "overlap_count", "source_unique", "target_unique", "confidence"
    )


def key_like_columns(schema: DataFrame) -> DataFrame:
    """Columns whose name marks them as a key."""
    return schema.where(key_like(F.col("column_name"))).select("table_name", "column_name")


def rank_by_target_uniqueness(found: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Order relationships so that targets that identify their rows come first."""
    rows = row_counts.select(F.col("table_name").alias("target_table"), "row_count")
    unique = F.coalesce(F.try_divide(F.col("target_unique"), F.col("row_count")), F.lit(0.0))
    return (
        found.join(rows, "target_table", "left")
        .withColumn("target_uniqueness", unique)
        .orderBy(F.desc("target_uniqueness"), F.desc("match_rate"), F.desc("overlap_count"))
    )


def graph_nodes(found: DataFrame) -> DataFrame:
    """Tables that take part in a relationship."""
    ends = found.select(F.inline(F.array(*[
        F.struct(F.col(c).alias("id")) for c in ("source_table", "target_table")
    ])))
    return ends.distinct().select("id", F.col("id").alias("label"))


def graph_edges(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("source_table").alias("source"),
        F.col("target_table").alias("target"),
        "source_column",
        "target_column",
        "match_rate",
        "confidence",
        "type",
    )


def join_opportunities(found: DataFrame, min_rate: float = 0.7) -> DataFrame:
    """Relationships strong enough to join on, with the equi-join written out."""
    text = F.format_string(
        "SELECT * FROM %s s JOIN %s t ON s.%s = t.%s",
        "source_table", "target_table", "source_column", "target_column",
    )
    return found.where(F.col("match_rate") >= min_rate).select(
        "source_table",
        "target_table",
        F.col("source_column").alias("join_column_source"),
        F.col("target_column").alias("join_column_target"),
        "match_rate",
        "confidence",
        text.alias("suggested_sql"),
    )


def touching(found: DataFrame, priority: DataFrame) -> DataFrame:
    """Relationships with either end among the priority ``(table_name, column_name)`` rows."""
    marked = priority.select("table_name", "column_name").distinct().withColumn("hit", F.lit(1))
    ends = []
    for side in ("source", "target"):
        ends.append(
            marked.select(
                F.col("table_name").alias(f"{side}_table"),
                F.col("column_name").alias(f"{side}_column"),
                F.col("hit").alias(f"{side}_hit"),
            )
        )
    joined = found.join(ends[0], ["source_table", "source_column"], "left").join(
        ends[1], ["target_table", "target_column"], "left"
    )
    return joined.where("source_hit = 1 OR target_hit = 1").select(*found.columns)


def touching_names(found: DataFrame, names: list[str]) -> DataFrame:
    """Relationships with either end given as ``table.column`` or as a bare column name."""
    keys = [
        F.concat_ws(".", "source_table", "source_column"),
        F.concat_ws(".", "target_table", "target_column"),
        F.col("source_column"),
        F.col("target_column"),
    ]
    hit = keys[0].isin(names)
    for key in keys[1:]:
        hit = hit | key.isin(names)
    return found.where(hit)


def join_coverage(
    source: DataFrame, source_column: str, target: DataFrame, target_column: str
) -> DataFrame:
    """Run a suggested join: matched and unmatched source rows, and rows of the join.

    Both sides are counted per key before they meet, so a hot key is one row on each side.
    """

    def per_key(df: DataFrame, name: str, out: str) -> DataFrame:
        key = col(name).alias("key")
        return nan_to_null(df).select(key).groupBy("key").agg(F.count(F.lit(1)).alias(out))

    left = per_key(source, source_column, "n_source")
    right = per_key(target, target_column, "n_target").where("key IS NOT NULL")
    joined = left.join(right, "key", "left")
    zero = F.lit(0).cast("bigint")
    matched = F.when(F.col("n_target").isNotNull(), F.col("n_source")).otherwise(zero)
    return joined.agg(
        F.coalesce(F.sum("n_source"), zero).alias("source_rows"),
        F.coalesce(F.sum(matched), zero).alias("matched_rows"),
        F.coalesce(F.sum(F.col("n_source") - matched), zero).alias("unmatched_rows"),
        F.coalesce(F.sum(F.col("n_source") * F.coalesce("n_target", zero)), zero).alias("joined_rows"),
    )
