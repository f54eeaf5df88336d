"""Basic string expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WHITESPACE


def strip(c: Column) -> Column:
    """Remove Unicode whitespace from both ends (Spark's plain ``trim`` removes spaces only)."""
    return F.trim(c, F.lit(WHITESPACE))


def normalise(c: Column) -> Column:
    """Stripped, lower-cased text: the form in which words are compared."""
    return F.lower(strip(c.cast("string")))


def word_array_sql(words: Sequence[str]) -> str:
    quoted = (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)
    return "array(" + ", ".join(f"'{w}'" for w in quoted) + ")"


def word_array(words: Sequence[str]) -> Column:
    """Constant array of strings, built in one call."""
    return F.expr(word_array_sql(words))
