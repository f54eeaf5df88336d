"""Row numbers over large groups without a task that holds a group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, named, spread


def slice_bits(rows: int, each: int | None = None) -> int:
    """Bits of a hash that deal ``rows`` rows into slices of about 4,000, or of their square root where that is more.

    So neither the rows of a slice nor the number of slices, which one task adds up, grows faster than the square root.
    """
    return max(0, (spread(rows, each or max(4_000, math.isqrt(rows))) - 1).bit_length())


def numbered(df: DataFrame, by: Sequence[str], key: Column, rows: int, name: str, each: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number from 0 within its group, without gaps, in the order of a hash of ``key``.

    Rows are dealt into slices of the hash. A slice's rows are numbered by a window, the rows of the slices before it
    are added from a table of counts; so a group with all rows costs no task more than a slice of them (``slice_bits``, or
    about ``each``). ``key`` must tell the rows of a group apart, and ``df`` must give the same rows when read again (a written table).
    """
    mark, part, before, own = (free_name([*df.columns, name], n) for n in ("_mark", "_slice", "_before", "_own"))
    bits = slice_bits(rows, each)
    marked = df.withColumn(mark, F.xxhash64(F.lit(name), key))
    marked = marked.withColumn(part, F.shiftrightunsigned(mark, 64 - bits).cast("int") if bits else F.lit(0))
    window = Window.partitionBy(*(named(c) for c in [*by, part])).orderBy(mark, key)
    inside = marked.withColumn(own, F.row_number().over(window).cast("long") - 1)
    if not bits and not by:
        return inside.withColumnRenamed(own, name).drop(mark, part)
    counts = marked.groupBy(*(named(c) for c in [*by, part])).agg(F.count("*").alias(own))
    running = Window.partitionBy(*(named(c) for c in by)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(named(c) for c in by), part, F.coalesce(F.sum(own).over(running), F.lit(0)).alias(before))
    return inside.join(starts, [*by, part]).withColumn(name, named(own) + named(before)).drop(mark, part, before, own)
