"""Joining a dictionary to a large table without a skewed shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell, free_name, name_key, present
from ..session import freeze, local_rows

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000
SALTS = 512


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frozen dictionary ``(_value, _n)`` of the values; combined map-side before it is shuffled."""
    return freeze(df.select(present(df, column).alias("_value")).where("_value is not null")
                  .groupBy("_value").agg(F.count(F.lit(1)).alias("_n")))


def with_dense_codes(dictionary: DataFrame) -> DataFrame:
    """Add ``_code``: 0, 1, 2, … in the order of ``_value``, without sorting everything in one task.

    The values are range-partitioned and frozen; a value's code is its place within its partition plus the sizes of
    the partitions before it. Only those sizes reach the driver.
    """
    placed = freeze(dictionary.repartitionByRange("_value").sortWithinPartitions("_value")
                    .withColumn("_place", F.monotonically_increasing_id()))
    # monotonically_increasing_id keeps the partition above bit 33.
    parted = (placed.withColumn("_part", F.shiftright("_place", 33))
              .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_part"], r["n"]) for r in parted.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = local_rows(dictionary.sparkSession, offsets, "_part long, _start long")
    return (parted.join(F.broadcast(starts), "_part")
            .withColumn("_code", F.col("_row") + F.col("_start"))
            .drop("_part", "_row", "_start", "_place"))


def attach(df: DataFrame, column: str, dictionary: DataFrame, payload: str, target: str, missing=None, *,
           broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of ``dictionary`` ``(_value, _n, payload)`` to ``df`` on ``column``, its payload as ``target``;
    unmatched rows get ``missing``.

    ``dictionary`` must be frozen, as it is measured first. A small one is broadcast. For a large one, the values that
    hold more than a thousandth of the rows (at most 1,000 of them) are broadcast if their bytes allow it, and every
    other row meets the rest of the dictionary in a shuffle join. Rows that are already answered, and rows without a
    value, carry a salt instead of it, so that neither a hot value nor null gathers in one task.
    """
    key = name_key(df.sparkSession)
    if key(target) in {key(c) for c in df.columns}:
        raise ValueError(f"columns exist already: {target}")
    taken = [*df.columns, target]
    value, answer, own = (free_name(taken, n) for n in ("_value", "_answer", "_own"))
    measure = F.sum(F.octet_length(F.col("_value").cast("string")))
    size = dictionary.agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("total"), measure.alias("bytes")).first()
    entries = dictionary.select(F.col("_value").alias(value), F.col(payload).alias(answer), "_n")
    source = df.withColumn(own, present(df, column))

    def result(joined: DataFrame, found: Column) -> DataFrame:
        filled = found if missing is None else F.coalesce(found, F.lit(missing))
        return joined.select(*[cell(c) for c in df.columns], filled.alias(target))

    if size["rows"] <= broadcast_rows and (size["bytes"] or 0) <= broadcast_bytes:
        found = source.join(F.broadcast(entries.drop("_n")), F.col(own) == F.col(value), "left")
        return result(found, F.col(answer))

    hot, hot_answer, still, spread, hashed = (
        free_name([*taken, value, answer, own], n) for n in ("_hot", "_hot_answer", "_open", "_spread", "_hash"))
    is_hot = F.col("_n") * HOT_KEYS > F.lit(size["total"])
    most = entries.where(is_hot).select(F.col(value).alias(hot), F.col(answer).alias(hot_answer))
    hot_bytes = most.agg(F.sum(F.octet_length(F.col(hot).cast("string")))).first()[0] or 0
    if hot_bytes > broadcast_bytes:
        # Too long to send everywhere: Spark splits the partitions that hot values make large.
        return result(source.join(entries.drop("_n"), F.col(own) == F.col(value), "left"), F.col(answer))
    cold = entries.where(~is_hot).drop("_n")
    step = source.join(F.broadcast(most), F.col(own) == F.col(hot), "left")
    # Both sides are placed by a hash of the value; rows without an open question take a running number instead. (A
    # constant on the other side would be folded into a filter and leave the value as the only key.)
    step = step.withColumn(still, F.when(F.col(hot).isNull(), F.col(own))).withColumn(
        spread, F.when(F.col(still).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        .otherwise(F.xxhash64(still)))
    joined = step.join(cold.withColumn(hashed, F.xxhash64(value)),
                       (F.col(spread) == F.col(hashed)) & (F.col(still) == F.col(value)), "left")
    return result(joined, F.coalesce(F.col(hot_answer), F.col(answer)))
