"""Whitening of embeddings by the covariance of their distinct vectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_rows
from .common import free_name, named, shuffle_partitions, small, write_down

#: Steps per unit and origin of the whole numbers that stand for a vector's entries.
SCALE, ORIGIN = 64, 1_000_000
#: A vector is hot if it stands in more than this share of the rows; there are at most as many as its inverse.
HOT_SHARE = 0.001
_OUT = ("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whole_numbers(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of each entry; null for a vector that is null or has an entry null or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(entries, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return F.when(good, F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(ORIGIN).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """A list column without nulls and of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _sums(dims: int, kind: str):
    """Weighted sums of the entries and of the weights, one row per entry and task; of whole numbers they are exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.float64 if kind == "double" else object)
        for batch in batches:
            values, weights = _matrix(batch.column(0), np.float64 if kind == "double" else np.int64), _weights(batch)
            if kind == "double":
                total[:dims] += weights @ values
            elif values.size and float(np.abs(values).max()) * float(weights.sum()) < 2.0**62:
                total[:dims] += (weights @ values).astype(object)
            else:
                total[:dims] += weights.astype(object) @ values.astype(object)
            total[dims] += int(weights.sum())
        sums = total.tolist() if kind == "double" else [Decimal(int(t)) for t in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims + 1), pa.int32()),
             pa.array(sums, pa.float64() if kind == "double" else pa.decimal128(38, 0))], names=["at", "total"])
    return run


def weighted_sums(vectors: DataFrame, dims: int, kind: str) -> tuple[list, int]:
    """Sum per entry of ``vector`` times ``weight``, and the sum of the weights. ``kind``: ``double`` or ``long``."""
    column = "total double" if kind == "double" else "total decimal(38,0)"
    parts = vectors.select("vector", "weight").mapInArrow(_sums(dims, kind), f"at int, {column}")
    found = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    whole = [found[i] if kind == "double" else int(found[i]) for i in range(dims)]
    return whole, int(found[dims])


class Centre:
    """``x - S/n`` in doubles without rounding the mean first: whole numbers are moved by a whole number, exactly."""

    def __init__(self, sums: list, n: int) -> None:
        if all(isinstance(s, int) for s in sums):
            base = [s // n for s in sums]
            rest = [(s - b * n) / n for s, b in zip(sums, base)]
        else:
            base, rest = [0] * len(sums), [s / n for s in sums]
        self.base, self.rest = np.array(base, np.int64), np.array(rest, np.float64)

    def apply(self, values: np.ndarray) -> np.ndarray:
        return (values - self.base).astype(np.float64) - self.rest


def _products(dims: int, centre: Centre, kind):
    """Weighted products of centred vectors, summed over a task by one matrix product per batch: a row per entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            centred = centre.apply(_matrix(batch.column(0), kind))
            total += (centred * _weights(batch)[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["at", "products"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of products with the same place added up; a task holds one row per place it owns."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, products in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = products.values.to_numpy(zero_copy_only=False)
            total[at] = total[at] + values if at in total else values.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                      pa.array(list(total.values()), pa.list_(pa.float64()))], names=["at", "products"])


def weighted_covariance(vectors: DataFrame, dims: int, kind: str = "long") -> tuple[np.ndarray, list, int]:
    """Covariance of ``vector`` under ``weight`` with divisor n, centred before multiplying; the sums and n besides.

    Two scans: sums, then one matrix product per Arrow batch. What is shuffled are ``dims`` rows per task; the driver
    receives one matrix of ``dims`` times ``dims``, whatever the number of vectors.
    """
    sums, n = weighted_sums(vectors, dims, kind)
    centre = Centre(sums, n)
    schema = "at int, products array<double>"
    parts = vectors.select("vector", "weight").mapInArrow(
        _products(dims, centre, np.float64 if kind == "double" else np.int64), schema)
    tasks = min(dims, shuffle_partitions(vectors.sparkSession))
    found = {r["at"]: r["products"] for r in parts.repartition(tasks, "at").mapInArrow(_added, schema).collect()}
    return np.array([found[i] for i in range(dims)]) / n, sums, n


def _whitened(sums: list, n: int, directions: np.ndarray):
    """Per distinct vector its components and its squared distance from the mean, times n squared, exactly."""
    centre = Centre(sums, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(0), np.int64)
            own = centre.apply(vectors) @ directions
            # Exact in 64 bits where the numbers allow it, else with whole numbers of any length.
            reach = n * float(np.abs(vectors - centre.base).max(initial=0)) + n
            if reach * reach * vectors.shape[1] < 2.0**62 and n * float(np.abs(vectors).max(initial=0)) < 2.0**62:
                off = n * vectors - np.array(sums, np.int64)
                deviation = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                off = n * vectors.astype(object) - np.array(sums, object)
                deviation = pa.array([Decimal(int(d)) for d in (off * off).sum(axis=1)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(own), pa.list_(pa.float64())), deviation],
                names=["x", "copies", "own", "deviation"])
    return run


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit eigenvectors as columns; those that are zero but for rounding fall out."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    good = values > max(values.max(initial=0.0), 0.0) * len(covariance) * 4 * np.finfo(float).eps
    return values[good], vectors[:, good]


def whiten(rows: DataFrame, components: int = 16, weights: str = "one", id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row with a usable vector and component.

    Vectors become whole numbers x (``whole_numbers``); rows whose vector is null or has an entry null or not finite are
    left out. The fit list is each distinct x vector, with weight one, or with the number of its rows for
    ``weights="counts"``: n is the sum of weights, S the weighted sums. Components are the unit eigenvectors of the
    covariance by falling eigenvalue, at most ``components``; ``whitened`` is the centred vector along one of them over
    the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``deviation`` the sum of
    ``(n x - S)^2``, ``identity_error`` the largest entry of the whitened vectors' covariance minus the identity.

    Rows that repeat give equal results. A table without a usable vector, vectors without entries or all equal give no
    rows, as there is no direction to whiten. Vectors of different lengths stop the job with an error that names the lengths; so do entries beyond
    the range of a long. Ids may be null, repeat and be of any type; other columns are not read.

    Rows meet in one map-side aggregate per distinct vector, however often it occurs. Results come back by a join on the
    vector: vectors of more than a thousandth of the rows, at most a thousand, are broadcast, all others shuffle.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights must be one or counts")
    spark = rows.sparkSession
    read = rows.select(named(id_column).alias("vec_id"), whole_numbers(named(vector_column)).alias("x")).filter("x IS NOT NULL")
    empty = local_rows(spark, [], f"vec_id {read.schema['vec_id'].dataType.simpleString()}, {_OUT}")
    distinct = write_down(read.groupBy("x").agg(F.count("*").alias("copies")), "whiten-distinct")
    seen = distinct.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.sum("copies").alias("rows")).first()
    if not seen["rows"] or not seen["most"]:
        return empty
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors have from {seen['least']} to {seen['most']} entries; whiten each length by itself")
    dims = seen["most"]
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    covariance, sums, n = weighted_covariance(distinct.select(F.col("x").alias("vector"), weight.alias("weight")), dims)
    values, directions = components_of(covariance, components)
    if not len(values):
        return empty
    own = distinct.select("x", "copies").mapInArrow(
        _whitened(sums, n, directions / np.sqrt(values)),
        "x array<long>, copies long, own array<double>, deviation decimal(38,0)")
    own = write_down(own, "whiten-own")
    again, _, _ = weighted_covariance(own.select(F.col("own").alias("vector"), weight.alias("weight")), len(values), "double")
    error = float(np.abs(again - np.eye(len(values))).max())

    least = max(1.0, seen["rows"] * HOT_SHARE)
    results = own.select("x", "own", "deviation")
    hot = F.broadcast(results.filter(F.col("copies") > least))  # at most 1 / HOT_SHARE rows
    others = small(write_down(results.filter(F.col("copies") <= least), "whiten-others"))
    found = read.join(hot, "x").unionByName(read.join(hot.select("x"), "x", "left_anti").join(others, "x"))
    shares = F.array(*(F.lit(float(v)) for v in values / np.trace(covariance)))
    return found.select("vec_id", "deviation", F.posexplode("own").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def with_whitened(rows: DataFrame, components: int = 16, weights: str = "one", id_column: str = "vec_id",
                  vector_column: str = "embedding", name: str = "whitened") -> DataFrame:
    """``rows`` with the array of their whitened components, null for rows that ``whiten`` leaves out; all columns stay.

    A number follows ``name`` where a column of that name is there. Ids must tell the rows apart, null among them.
    """
    name = free_name(rows.columns, name)
    key = free_name([*rows.columns, name], "_whitened_id")
    own = whiten(rows, components, weights, id_column, vector_column)
    arrays = own.groupBy(F.col("vec_id").alias(key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "whitened"))), lambda s: s["whitened"]).alias(name))
    return rows.join(arrays, named(id_column).eqNullSafe(F.col(key)), "left").drop(key)
