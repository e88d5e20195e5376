"""Language identification by compression: one raw-content zstandard dictionary per language."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.llm.frames import attach, once

UNDETERMINED = "und"
SAMPLE_TEXTS = 300  # texts per language from which a dictionary is filled, at most
SPARE = 1.5  # times as many are looked at, so that the share rarely holds fewer
DICTIONARY_BYTES = 131_072
SLICE_CHARS = 1024  # of a longer text, a slice at a hashed place is used, of at least this length
FRAME_BYTES = 1024  # a text is compressed in frames, each with the dictionary as its past
LEVEL = 9
MARGIN = 0.005  # bytes that the second best must need more, for each byte of the best, in whole bytes


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary content by language."""

    content: tuple[tuple[str, bytes], ...]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Dictionaries from at most ``SAMPLE_TEXTS`` texts of each language, chosen by a hash.

    Rows of a null language, null text or a text without words are not used. Of a text longer
    than ``SLICE_CHARS`` (or than an equal part of the dictionary, where a language has few
    texts) a slice at a hashed place stands for it, so languages of long texts alone are learned
    too. Equal texts count once, whatever their ids, and a null id changes nothing. Languages
    without a usable text are not learned; from an empty table nothing is.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(
        F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)
    )
    rows = rows.withColumn("place", F.xxhash64("text"))
    # distinct texts, so that copies neither fill nor empty the share
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()
    whole = 1 << 30
    bound, width = F.lit(0), F.lit(SLICE_CHARS)
    for r in sizes:
        share = int(whole * SPARE * SAMPLE_TEXTS / max(1, r["n"])) + 1
        bound = F.when(F.col("lang") == r["lang"], share).otherwise(bound)
        part = max(SLICE_CHARS, -(-DICTIONARY_BYTES // max(1, r["n"])))
        width = F.when(F.col("lang") == r["lang"], part).otherwise(width)
    near = rows.where(F.pmod("place", F.lit(whole)) < bound).withColumn("width", width)
    begin = F.pmod(F.xxhash64("place"), F.greatest(F.length("text") - F.col("width") + 1, F.lit(1)))
    near = near.select(
        "lang", "place", F.substring(F.col("text"), begin.cast("int") + 1, F.col("width")).alias("text")
    ).dropDuplicates(["lang", "place", "text"])
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(whole)), "text")
    drawn = (
        near.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= SAMPLE_TEXTS)
        .select("lang", "text", "place")
        .toPandas()
        .sort_values(["lang", "place", "text"])
    )
    content = []
    for name, part in drawn.groupby("lang", sort=True):
        # what stands last in a dictionary is cheapest to refer to; the order is by hash
        raw = "\n".join(part["text"]).lower().encode("utf-8", "replace")
        content.append((name, raw[:DICTIONARY_BYTES]))
    return LanguageModel(tuple(content))


@lru_cache(1)  # one model's: a compressor of this level holds some megabytes
def _compressors(model: LanguageModel) -> list:
    out = []
    for _, content in model.content:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False))
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def sizes(model: LanguageModel, text: str) -> list[int]:
    """Bytes of the whole text in lower case, compressed with each language's dictionary."""
    raw = text.lower().encode("utf-8", "replace")
    frames = [raw[i : i + FRAME_BYTES] for i in range(0, len(raw), FRAME_BYTES)]
    return [sum(len(c.compress(f)) for f in frames) for c in _compressors(model)]


def identify(
    df: DataFrame,
    model: LanguageModel,
    text: str = "text",
    margin: float = MARGIN,
    columns: list[str] | None = None,
) -> DataFrame:
    """``df`` (or ``columns`` of it) with lang_pred, score and rejected.

    lang_pred is the language whose dictionary makes the whole text smallest, the first by name
    on ties; ``und`` for a null text, one without a letter, or where nothing was learned. score
    rises from 0 to 1 with the bytes that the second best needs more. rejected holds for
    ``und`` and where these are fewer than ``margin`` for each byte that the best needs, in whole
    bytes: the size of a text of a few words has no room for a margin of that share, which says
    nothing against it. A single learned language is never rejected for its margin. Input
    columns of these names are replaced; repeated rows stay.
    """
    names = [name for name, _ in model.content]

    def guess(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if not names or not has_letter(t):
                rows.append((UNDETERMINED, 0.0, True))
                continue
            found = sizes(model, t)
            best = int(np.argmin(found))
            others = [s for i, s in enumerate(found) if i != best]
            gap = min(others) - found[best] if others else found[best]
            unclear = gap < int(margin * found[best])
            rows.append((names[best], 1.0 - float(np.exp(-gap / 8.0)), unclear))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    found = once(guess, "lang_pred string, score double, rejected boolean")(F.col(f"`{text}`"))
    results = ["lang_pred", "score", "rejected"]
    kept = df.columns if columns is None else columns
    held = attach(df, {"_found": found}, [c for c in kept if c.lower() not in results])
    return held.select(
        *[F.col(f"`{c}`") for c in held.columns if c != "_found"],
        *[F.col(f"_found.{c}").alias(c) for c in results],
    )
