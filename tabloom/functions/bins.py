"""Right-closed binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """The ``bins + 1`` edges of equal-width bins over a range.

    The lowest edge is moved down by 0.1% of the range so that the minimum falls inside. A range of one value is widened
    by 0.1% of it on both sides first.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
        first = lo
    else:
        first = lo - (hi - lo) * 0.001
    step = (hi - lo) / bins
    return [first, *[i * step + lo for i in range(1, bins)], hi]


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """1-based number of the right-closed bin of ``x``; the lowest edge belongs to bin 1, values outside give null.

    A balanced tree of comparisons with constants: log2(bins) per row, all inside generated code.
    """
    def search(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(x <= edges[middle], search(first, middle)).otherwise(search(middle + 1, last))

    if len(edges) < 2:
        return F.lit(None).cast("int")
    return F.when(x.between(edges[0], edges[-1]), search(1, len(edges) - 1))
