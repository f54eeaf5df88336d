"""Correlations of all pairs of columns in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transforms import number

#: Columns of a block: a task holds six sums for each pair of a block's columns with all others.
BLOCK = 512
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_SCHEMA = "i int, " + ", ".join(f"{s} array<double>" for s in _SUMS)
#: Rows whose means move the values towards zero, so that squares of large values do not cancel out.
_FIRST = 1_000


def _rows_of(places: Sequence[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int32()), *(pa.array(list(s), pa.list_(pa.float64())) for s in sums)], names=["i", *_SUMS])


def _products(low: int, high: int):
    """Sums of a task over the rows where both columns of a pair have a value, by matrix products: a row per column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)
            there = ~np.isnan(x)
            x, w = np.where(there, x, 0.0), there.astype(np.float64)
            a, wa = x[:, low:high], w[:, low:high]
            sums = [wa.T @ w, a.T @ w, wa.T @ x, (a * a).T @ w, wa.T @ (x * x), a.T @ x]
            total = sums if total is None else [t + s for t, s in zip(total, sums)]
        if total is not None:
            yield _rows_of(range(low, high), total)
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same column added up."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, i in enumerate(batch.column(0).to_pylist()):
            sums = [c[k].values.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            total[i] = [t + s for t, s in zip(total[i], sums)] if i in total else [s.copy() for s in sums]
    if total:
        yield _rows_of(list(total), [np.array([own[k] for own in total.values()]) for k in range(len(_SUMS))])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``x, y, r``: Pearson correlation of every pair of ``columns``, both ways and with itself, over the rows where both
    have a value; null where that is not defined.

    One scan for up to 512 columns, one more for each further block of them: sums of products are matrix products of Arrow
    batches, and presence masks tell which rows a pair has in common. What is shuffled are six numbers per pair and task. Values
    are first moved by the means of some first rows, which changes no correlation but keeps sums of squares small.
    """
    values = df.select(*[number(c).alias(f"v{k}") for k, c in enumerate(columns)])
    usual = values.limit(_FIRST).agg(*[F.avg(F.when(F.abs(f"v{k}") < float("inf"), F.col(f"v{k}"))).alias(f"v{k}")
                                       for k in range(len(columns))]).first()
    moved = values.select(*[(F.col(f"v{k}") - F.lit(usual[k] or 0.0)).alias(f"v{k}") for k in range(len(columns))])
    parts = None
    for low in range(0, len(columns), BLOCK):
        own = moved.mapInArrow(_products(low, min(low + BLOCK, len(columns))), _SCHEMA)
        parts = own if parts is None else parts.unionAll(own)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = parts.repartition(min(tasks, len(columns)), "i").mapInArrow(_added, _SCHEMA)
    pairs = whole.select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("j", "s")).select("i", "j", "s.*")
    n = F.col("n")
    x2, y2 = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    xy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # A constant column has no correlation; what rounding leaves of its squares is none.
    flat = (x2 <= F.col("sxx") * 1e-13) | (y2 <= F.col("syy") * 1e-13)
    r = F.when((n > 0) & ~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), xy / F.sqrt(x2 * y2))))
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.select(F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"),
                        F.when(F.col("i") == F.col("j"), F.when((n > 0) & ~flat, 1.0)).otherwise(r).alias("r"))
