"""Several values in one cell."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


# Runs of Unicode whitespace.
_BLANKS = (r"[\s\x{85}\x{a0}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def part_count(c: Column, sep: str) -> Column:
    """Number of parts ``c`` falls into at ``sep``, counted without building them."""
    removed = F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit("")))
    return (removed / F.lit(len(sep))).cast("int") + 1


def split_tags(c: Column, sep: str | Column | None, drop_nan: bool = True) -> Column:
    """Array of stripped, non-blank parts; ``sep=None`` splits at whitespace. Null gives an empty array."""
    if sep is None:
        pattern: str | Column = _BLANKS
    elif isinstance(sep, str):
        pattern = rf"\Q{sep}\E"
    else:
        pattern = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    parts = F.transform(F.split(c.cast("string"), pattern, -1), strip)
    blank = ("", "nan") if drop_nan else ("",)
    kept = F.filter(parts, lambda t: ~F.lower(t).isin(*blank))
    return F.coalesce(kept, F.array().cast("array<string>"))


def tag_suffix(tag: str) -> str:
    """Column-name form of a tag: runs outside ``[a-zA-Z0-9_]`` become one underscore."""
    return re.sub(r"[^a-zA-Z0-9_]+", "_", tag).strip("_")
