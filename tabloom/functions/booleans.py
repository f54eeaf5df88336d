"""Text to boolean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TRUE_WORDS
from .text import normalise


def boolean_from_text(c: Column, true_values: Sequence[str] | None = None) -> Column:
    """True for the listed words, null for blank or ``nan``, False for every other text."""
    words = sorted({w.lower() for w in (TRUE_WORDS if true_values is None else true_values)})
    text = normalise(c)
    missing = text.isNull() | text.isin("", "nan")
    # A listed word wins over the missing rule, so that "nan" can be declared true.
    return F.when(text.isin(*words), F.lit(True)).when(~missing, F.lit(False))
