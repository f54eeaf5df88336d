"""Numbers hidden in text: currency signs, thousands separators, percent signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CURRENCY_CHARS, WHITESPACE
from .text import strip

# Spark's cast also takes "1d" and "1f", so the shape is checked before casting.
_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))$"


def numeric_from_text(c: Column, decimal: str = ".") -> Column:
    """Text to double, null where the cleaned text is not a number.

    Currency signs, whitespace, thousands separators and percent signs are dropped. ``decimal=","`` reads the
    continental form, in which the dot groups thousands: ``1.234,56`` gives 1234.56.
    """
    if decimal not in (".", ","):
        raise ValueError("decimal must be '.' or ','")
    text = c.cast("string")
    if decimal == ".":
        cleaned = F.translate(text, CURRENCY_CHARS + WHITESPACE + ",%", "")
    else:
        # translate maps the first characters one to one and deletes the rest: "," becomes ".".
        cleaned = F.translate(text, "," + CURRENCY_CHARS + WHITESPACE + ".%", ".")
    return F.when(cleaned.rlike(_NUMBER), cleaned.try_cast("double"))


def text_prefix(c: Column) -> Column:
    """Leading run without digits or signs, such as ``R$``; null when there is none."""
    return F.nullif(strip(F.regexp_extract(strip(c), r"^[^0-9\-+]+", 0)), F.lit(""))


def text_suffix(c: Column) -> Column:
    """Trailing run without digits, such as ``%``; null when there is none."""
    return F.nullif(strip(F.regexp_extract(strip(c), r"[^0-9]+$", 0)), F.lit(""))
