"""Position on an ordered scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_ORDINAL_WORDS, ORDINAL_SCALES
from .text import normalise, word_array, word_array_sql


def ordinal_rank(c: Column, order: Sequence[str]) -> Column:
    """0-based position of the normalised value in ``order``; null for values off the scale."""
    place = F.array_position(word_array([level.strip().lower() for level in order]), normalise(c))
    return F.when(place > 0, (place - 1).cast("int"))


def matching_scale(words: Column) -> Column:
    """First known scale that holds all of an array of 2 to 15 distinct words, cut to those words; else null."""
    scales = F.expr("array(" + ", ".join(word_array_sql(scale) for scale in ORDINAL_SCALES) + ")")
    covering = F.filter(scales, lambda scale: F.size(F.array_except(words, scale)) == 0)
    fits = (F.size(words) >= 2) & (F.size(words) <= MAX_ORDINAL_WORDS)
    return F.when(fits, F.array_intersect(F.get(covering, F.lit(0)), words))
