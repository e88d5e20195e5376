"""The corpus pipeline: language, quality, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as
Parquet and read again as the next stage's documents. All stages but the last return the
columns of ``documents`` (and any further ones that came in), and work on all that their
predecessor kept. A stage fits its model on the documents it is given, quality with the labels
of ``sf_dir``. An empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import language_id, pii, quality_classifier, simhash
from tablescout.llm.frames import keep, small_batches, work_folder
from tablescout.llm.queries import packed


def _held(docs: DataFrame) -> DataFrame:
    """The rows as one column beside their text, so that no name meets an operator's result."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text")
    )


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (a null text too) and those of no clear language."""
    found = language_id.identify(_held(docs), language_id.fit(docs), "_text", columns=["_doc"])
    return found.where(~F.col("rejected")).select("_doc.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules, fitted on the labelled ones, predict to be poor."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(_held(docs), model, "_text", columns=["_doc"])
    return scored.where("predicted = 1").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group; of repeated rows any one."""
    named = _held(docs).select(
        "*", F.struct("_doc.doc_id", F.monotonically_increasing_id().alias("row")).alias("_id")
    )
    found = simhash.near_duplicates(
        named, work_folder(spark, "simhash"), "_id", "_text", columns=["_doc", "_id"]
    )
    return found.where(F.col("_id").eqNullSafe(F.col("component_id"))).select("_doc.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows."""
    found = pii.detect(_held(docs), pii.fit(docs), "_text", columns=["_doc"])
    changed = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(
        *[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns]
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Hashing, training and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), folder, name)
    return docs
