"""Quality rules by distribution divergence from references of the corpus' languages.

Each document's histograms of character classes and of common words are compared with those of
every language by the Jensen-Shannon distance; a document far from its nearest language fails.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.llm.frames import attach, once
from tablescout.llm.text_stats import (
    CLASSES,
    character_counts,
    repeated_lines,
    repeated_words,
    split_words,
)

COMMON_WORDS = 50  # words of each language that have a place of their own in its histogram
BUCKETS = 256  # of words, in which the common ones are looked for
CLASS_DISTANCE = 0.27  # farther from every language fails
WORD_DISTANCE = 0.36  # of texts of FULL_WORDS words and more
FULL_WORDS = 100  # shorter texts may be farther, as sampling noise is
LEAST_CHARACTERS = 200  # shorter texts are not judged by their character classes
LEAST_WORDS = 50  # nor those of fewer words by their common words
FEWEST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, per cent of repeated words
HELD_WORDS = 100_000  # words whose counts a task holds before it passes them on


@dataclass(frozen=True)
class References:
    """Per language: shares of character classes, common words and the shares of these."""

    languages: tuple[str, ...]
    classes: np.ndarray
    words: tuple[tuple[str, ...], ...]
    shares: tuple[np.ndarray, ...]


def _counted(batches):
    held: Counter = Counter()
    for part in batches:
        texts = part["text"].tolist()
        counts, _, _ = character_counts(texts)
        for lang, text, row in zip(part["lang"].tolist(), texts, counts.tolist(), strict=True):
            for name, n in zip(CLASSES, row, strict=True):
                held[lang, True, name] += n
            for word, n in Counter(text.lower().split()).items():
                held[lang, False, word] += n
            if len(held) >= HELD_WORDS:
                yield _rows(held)
                held.clear()
    yield _rows(held)


def _rows(held: Counter) -> pd.DataFrame:
    return pd.DataFrame(
        [(lang, is_class, item, n) for (lang, is_class, item), n in held.items()],
        columns=["lang", "is_class", "item", "n"],
    )


def references(
    df: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON_WORDS
) -> References:
    """Histograms per language over all texts of a known language; counts meet per word.

    Rows of a null text or language add nothing. Languages are those named in the table; the
    driver gets ``common`` words of each.
    """
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(
        "text is not null and lang is not null"
    )
    counted = (
        rows.mapInPandas(_counted, "lang string, is_class boolean, item string, n long")
        .groupBy("lang", "is_class", "item")
        .agg(F.sum("n").alias("n"))
    )
    # Ranked within buckets of words, so that no task sees all words of a language; the driver
    # gets at most ``common`` words of each bucket and language.
    group = Window.partitionBy("lang", "is_class", "bucket")
    found = (
        counted.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(BUCKETS)))
        .withColumn("total", F.sum("n").over(group))
        .withColumn("place", F.row_number().over(group.orderBy(F.desc("n"), "item")))
        .where(F.col("place") <= common)
        .toPandas()
    )
    classes, words, totals = {}, {}, {}
    for (name, is_class), rows in found.groupby(["lang", "is_class"]):
        if is_class:
            classes[name] = dict(zip(rows["item"], rows["n"], strict=True))
        else:
            top = rows.sort_values(["n", "item"], ascending=[False, True])[:common]
            words[name] = list(zip(top["item"], top["n"], strict=True))
            totals[name] = rows.drop_duplicates("bucket")["total"].sum()
    names = sorted(set(classes) & set(words))
    tables, lists, shares = [], [], []
    for name in names:
        row = np.array([classes[name].get(c, 0) for c in CLASSES], float)
        tables.append(row / max(1.0, row.sum()))
        share = np.array([n for _, n in words[name]], float) / totals[name]
        lists.append(tuple(w for w, _ in words[name]))
        shares.append(np.append(share, max(0.0, 1.0 - share.sum())))
    return References(
        tuple(names),
        np.array(tables).reshape(len(names), len(CLASSES)),
        tuple(lists),
        tuple(shares),
    )


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in base 2 along the last axis: 0 to 1."""
    middle = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(x > 0, x * np.log2(x / middle), 0.0)
        return terms.sum(axis=-1) / 2

    return np.sqrt(np.maximum(0.0, part(p) + part(q)))


def distances(texts: list[str], counts: np.ndarray, known: References) -> np.ndarray:
    """Per text: distance of classes and of common words to the nearest language; 0 if none."""
    out = np.zeros((len(texts), 2))
    if not known.languages:
        return out
    shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    out[:, 0] = js_distance(shares[:, None, :], known.classes[None]).min(axis=1)
    for i, text in enumerate(texts):
        found = Counter(text.lower().split())
        total = sum(found.values())
        if total:
            nearest = 1.0
            for words, share in zip(known.words, known.shares, strict=True):
                mine = np.array([found.get(w, 0) for w in words], float) / total
                mine = np.append(mine, max(0.0, 1.0 - mine.sum()))
                nearest = min(nearest, float(js_distance(mine, share)))
            out[i, 1] = nearest
    return out


RESULTS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "base_failed": "boolean", "class_distance": "double",
    "word_distance": "double", "kept": "boolean",
}


def judge(
    df: DataFrame,
    known: References,
    text: str = "text",
    columns: list[str] | None = None,
    class_distance: float = CLASS_DISTANCE,
    word_distance: float = WORD_DISTANCE,
) -> DataFrame:
    """``df`` (or ``columns`` of it) with the counts, distances and verdict of every whole text.

    base_failed: fewer than ``FEWEST_WORDS`` words, or more than ``MOST_REPEATED`` per cent of
    them in repeated windows. kept: not base_failed, and near a language in both histograms,
    each judged only from a minimum length on. A null text counts as empty. Input columns of
    the result names are replaced; repeated rows stay. Without references only the base rules
    judge.
    """

    def verdict(texts: pd.Series) -> pd.DataFrame:
        whole = [t or "" for t in texts]
        counts, in_words, symbols = character_counts(whole)
        far = distances(whole, counts, known)
        words = [split_words(t) for t in whole]
        n_words = np.array([len(w) for w in words], np.int64)
        repeated = np.array([repeated_words(w) for w in words], np.int64)
        failed = (n_words < FEWEST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
        odd = (counts.sum(axis=1) >= LEAST_CHARACTERS) & (far[:, 0] > class_distance)
        allowed = word_distance * np.sqrt(np.maximum(1, FULL_WORDS / np.maximum(1, n_words)))
        odd |= (n_words >= LEAST_WORDS) & (far[:, 1] > allowed)
        values = [
            n_words, in_words, symbols, np.array([repeated_lines(t)[0] for t in whole], np.int64),
            repeated, failed, far[:, 0], far[:, 1], ~failed & ~odd,
        ]
        return pd.DataFrame(dict(zip(RESULTS, values, strict=True)))

    kind = ", ".join(f"{k} {v}" for k, v in RESULTS.items())
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in RESULTS]
    held = attach(df, {"_v": once(verdict, kind)(F.col(f"`{text}`"))}, kept)
    return held.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_v.{c}").alias(c) for c in RESULTS])
