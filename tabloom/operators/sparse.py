"""Indicators of many tags or values as one sparse column: the numbers of those a row holds, and a dictionary of names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cell, free_name, present, split_tags
from ..session import freeze, stored
from .encode import add_columns
from .lookup import BROADCAST_BYTES, BROADCAST_ROWS, with_dense_codes


@dataclass
class Sparse:
    """``data`` has the sparse column ``name``; ``dictionary`` (``code, value, n``) tells what its numbers mean."""

    data: DataFrame
    name: str
    dictionary: DataFrame

    def indicator(self, value: str) -> Column:
        """1 where a row holds ``value``, else 0: a column on request."""
        code = self.dictionary.where(F.col("value") == value).select("code").first()
        return F.lit(0) if code is None else F.array_contains(cell(self.name), F.lit(code[0])).cast("int")

    def with_indicators(self, values: dict[str, str]) -> DataFrame:
        """``data`` with a 0/1 column per entry of ``values`` (new name to value)."""
        return add_columns(self.data, {name: self.indicator(value) for name, value in values.items()})

    def sums(self) -> DataFrame:
        """``value, n``: the rows that hold each value, by the sparse column."""
        held = self.data.select(F.explode(cell(self.name)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        return self.dictionary.select("code", "value").join(held, "code", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def _coded(codes: dict[str, int], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(codes[v] for v in row) for row in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return run


def _sparse(df: DataFrame, values: Column, name: str, broadcast_rows: int, broadcast_bytes: int) -> Sparse:
    held = df.withColumn(name, values)
    counts = held.select(F.explode(name).alias("_value")).groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    dictionary = freeze(with_dense_codes(freeze(counts)).select(
        F.col("_code").cast("long").alias("code"), F.col("_value").alias("value"), F.col("_n").alias("n")))
    size = dictionary.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0)).alias("bytes")).first()
    schema = T.StructType([*held.schema.fields[:-1], T.StructField(name, T.ArrayType(T.LongType()))])
    if size["n"] <= broadcast_rows and size["bytes"] <= broadcast_bytes:
        codes = {r["value"]: r["code"] for r in dictionary.collect()}
        return Sparse(held.mapInArrow(_coded(codes, len(held.columns) - 1), schema), name, dictionary)
    # A larger dictionary meets the values in a shuffle; hot values are few rows of it, and Spark splits their partitions.
    row = free_name(held.columns, "_row")
    numbered = stored(held.withColumn(row, F.monotonically_increasing_id()))
    found = (numbered.select(row, F.explode(name).alias("value")).join(dictionary.select("code", "value"), "value")
             .groupBy(row).agg(F.array_sort(F.collect_list("code")).alias("_codes")))
    coded = numbered.drop(name).join(found, row, "left").withColumn(name, F.coalesce("_codes", F.array().cast("array<long>")))
    return Sparse(coded.select(*[cell(c) for c in held.columns]), name, dictionary)


def sparse_tags(df: DataFrame, column: str, sep: str | None, output: str | None = None, *,
                broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> Sparse:
    """The tags of a column as sorted numbers, in one array column ``{column}_tags`` however many tags there are.

    Numbers follow the order of the tags. A dictionary of up to 100,000 tags and 64 MB travels to the tasks; a larger one
    is joined.
    """
    name = free_name(df.columns, output or f"{column}_tags")
    return _sparse(df, F.array_distinct(split_tags(cell(column), sep)), name, broadcast_rows, broadcast_bytes)


def sparse_onehot(df: DataFrame, column: str, output: str | None = None, *, broadcast_rows: int = BROADCAST_ROWS,
                  broadcast_bytes: int = BROADCAST_BYTES) -> Sparse:
    """The value of a cell, as text, as an array of its number; empty where the cell is missing."""
    name = free_name(df.columns, output or f"{column}_value")
    value = present(df, column).cast("string")
    held = F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
    return _sparse(df, held, name, broadcast_rows, broadcast_bytes)
