"""What several corpus operators share: result columns, kept tables and connected components."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "8m"
CHUNK_CHARS = 500_000  # texts are handled in groups of about this many characters


def attach(df: DataFrame, results: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) beside the result columns.

    A column of ``df`` with the name of a result, in any case, gives way to the result.
    """
    taken = {name.lower() for name in results}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    return df.select(*[F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in results.items()])


def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> None:
    """Bound what a Python worker gets at once by its bytes, not only by its rows.

    A setting of the session: with Spark's own bound, a batch of long texts, its copies in the
    worker and its results come to hundreds of megabytes for each core.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def once(function, kind: str):
    """A Pandas UDF that Spark evaluates once per row.

    Marked nondeterministic, so that the optimizer neither repeats it for each use of its
    result nor derives filters from it; its results are the same each time nevertheless.
    """
    return F.pandas_udf(function, kind).asNondeterministic()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names in ``spark.checkpoint.dir``.

    Where none is named, a session within one process gets a temporary folder; on a cluster,
    whose executors do not share the driver's folders, that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid4().hex}"


def keep(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write once to shared storage and read from there: survives lost executors, cuts lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chunks(texts, limit: int = CHUNK_CHARS):
    """Ranges (first, past) of consecutive texts of about ``limit`` characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Forest:
    """Union by smallest member with path halving, over positions 0 to n - 1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges member -> smallest member of its component, for the given edges alone."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = flat.reshape(2, -1)
    forest = Forest(len(nodes))
    for i, j in zip(ends[0].tolist(), ends[1].tolist(), strict=True):
        forest.join(i, j)
    roots = np.array([forest.find(i) for i in range(len(nodes))], dtype=np.int64)
    apart = roots != np.arange(len(nodes))
    return nodes[apart], nodes[roots[apart]]


def components(edges: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), two longs.

    Returns (node, component) for every node that has an edge to another one; the component is
    its smallest node. Alternates the large-star and small-star steps until the edges form
    stars: each step is a minimum per node, combined before the shuffle, and a join that AQE
    can split at a node with very many edges. No component is gathered in one task; every
    round is kept on shared storage. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    pairs = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    pairs = keep(pairs, folder, "edges-0")

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(
            df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        )

    last = fingerprint(pairs)
    if last[0] == 0:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for turn in range(1, max_rounds + 1):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = keep(large, folder, f"large-{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                      F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        pairs = keep(small, folder, f"edges-{turn}")
        now = fingerprint(pairs)
        if now == last:
            return spark.read.schema(pairs.schema).parquet(f"{folder}/edges-{turn}").select(
                F.col("a").alias("node"), F.col("b").alias("component")
            )
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
