"""Text rules: key-like names, number-like and blank values, percent text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name suffixes and whole names that mark a key column.
KEY_SUFFIXES = ["_id", "_code", "_key", "_pk", "_fk"]
KEY_NAMES = ["id", "code", "key"]

# The characters that make a text look like a date.
DATE_MARKS = ["-", "/", "T"]
BLANK_PATTERN = r"^\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
KEY_PATTERN = "(" + "|".join(KEY_SUFFIXES) + ")$|^(" + "|".join(KEY_NAMES) + ")$"


def is_key_like(name: str) -> bool:
    return re.search(KEY_PATTERN, name.lower()) is not None


def key_like(name: Column) -> Column:
    return F.lower(name).rlike(KEY_PATTERN)


def percent_text(part: Column, whole: Column) -> Column:
    """``part / whole`` as text with one decimal, e.g. ``12.5%``; 0.0% for an empty whole."""
    tenths = F.coalesce(
        F.floor(F.try_divide(part * 2000 + whole, whole * 2)), F.lit(0).cast("bigint")
    )
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")
    )
