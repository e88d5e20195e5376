"""Counts over whole texts: character classes, words, repeated lines and repeated word windows."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from tablescout.llm.frames import text_chunks

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ["lower", "upper", "letter", "digit", "space", "line", "mark", "symbol"]
LOWER, UPPER, LETTER, DIGIT, SPACE, LINE, MARK, SYMBOL = range(8)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Character class of every code point."""
    of_category = {"Ll": LOWER, "Lu": UPPER, "N": DIGIT, "L": LETTER, "M": LETTER, "P": MARK, "Z": SPACE}
    table = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        found = of_category.get(kind, of_category.get(kind[0]))
        if found is not None:
            table[c] = found
    table[[9, 11, 12, 32]] = SPACE
    table[[10, 13]] = LINE
    for c in SYMBOLS:
        table[ord(c)] = SYMBOL
    return table


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in SYMBOLS]] = True
    return table


def character_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: characters of each class, characters in words, and characters of `SYMBOLS`.

    Words end at ASCII white space.
    """
    counts = np.zeros((len(texts), len(CLASSES)), np.int64)
    in_words, symbols = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for first, past in text_chunks(texts):
        group = texts[first:past]
        codes = np.frombuffer("".join(group).encode("utf-32-le", "replace"), "<u4")
        owner = np.repeat(np.arange(past - first), [len(t) for t in group])
        n, width = past - first, len(CLASSES)
        flat = np.bincount(owner * width + class_table()[codes], minlength=n * width)
        counts[first:past] = flat.reshape(n, width)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        in_words[first:past] = np.bincount(owner[~blank], minlength=n)
        symbols[first:past] = np.bincount(owner[_symbol_table()[codes]], minlength=n)
    return counts, in_words, symbols


def split_words(text: str) -> list[str]:
    """Words between ASCII white space (other white space is part of a word)."""
    raw = text.encode("utf-8", "surrogatepass").split()
    return b" ".join(raw).decode("utf-8", "surrogatepass").split(" ") if raw else []


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first included."""
    if len(words) <= width:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    windows = len(ids) - width + 1
    key = ids[:windows]
    for k in range(1, width):
        if key.max() >= (1 << 62) // max(1, len(number)):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + ids[k : k + windows]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + windows] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)
