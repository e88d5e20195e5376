"""Results that several later steps read: schema-sized facts, and findings on shared storage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tablescout.functions.sqltext import local_frame

AT_ONCE = 6
Item, Result = TypeVar("Item"), TypeVar("Result")


def pin(df: DataFrame) -> DataFrame:
    """Evaluate a frame of one row per column (or table) once, for several rules to read.

    Only for frames whose size follows the schema and not the data: without it, every rule
    that reads the facts would scan the tables again.
    """
    return local_frame(df.sparkSession, df.collect(), df.schema)


def work_folder(spark: SparkSession) -> str:
    """A new folder on the storage that the session names for checkpoints.

    Where none is named, a session within one process gets a temporary folder; on a cluster,
    whose executors do not share the driver's folders, that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/tablescout-{uuid4().hex}"


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write findings once and read them from there, so that later steps do not scan again.

    The files outlive any executor.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(work: Callable[[Item], Result], items: Iterable[Item]) -> list[Result]:
    """``work`` of each item, in order; a few items start their jobs side by side.

    So the short jobs of small tables run while the long ones of a large table do.
    """
    with ThreadPoolExecutor(AT_ONCE) as threads:
        return list(threads.map(work, items))
