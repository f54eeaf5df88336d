"""Cells that differ between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cell, present
from ..session import freeze, local_rows

#: Buckets of keys on each of the two levels of the tree.
FAN = 256


def _marks(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> list[Column]:
    """Per column a hash of the key and the cell. Equal cells of equal keys have equal ones, whatever the row order."""
    own = [present(df, k).cast("string") for k in key]
    return [F.xxhash64(F.lit(c), *own, F.coalesce(present(df, c).cast("string"), F.lit("\0"))).alias(f"h{i}")
            for i, c in enumerate(columns)]


def _bucket(df: DataFrame, key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[present(df, k).cast("string") for k in key]), F.lit(FAN * FAN))


def _fingerprints(df: DataFrame, key: Sequence[str], columns: Sequence[str], bucket: Column) -> DataFrame:
    """``bucket, n, s0, x0, …``: rows of a bucket, and per column the sum and the exclusive-or of its hashes."""
    marks = df.select(bucket.alias("bucket"), *_marks(df, key, columns))
    sums = []
    for i in range(len(columns)):
        # Halves, so that sums cannot overflow; with the exclusive-or a multiset is told by 96 bits.
        sums += [F.sum(F.shiftright(f"h{i}", 32)).alias(f"s{i}"), F.bit_xor(f"h{i}").alias(f"x{i}")]
    return marks.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums)


def changed_buckets(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``bucket, changed``: buckets of keys whose fingerprints differ, and which columns do. At most 65,536 rows meet."""
    a = _fingerprints(old, key, columns, _bucket(old, key))
    b = _fingerprints(new, key, columns, _bucket(new, key))
    a, b = (t.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in t.columns if c != "bucket"]) for t, side in ((a, "a"), (b, "b")))
    both = a.join(b, "bucket", "full")
    differs = [F.when(~(F.col(f"s{i}_a").eqNullSafe(F.col(f"s{i}_b")) & F.col(f"x{i}_a").eqNullSafe(F.col(f"x{i}_b"))
                        & F.col("n_a").eqNullSafe(F.col("n_b"))), F.lit(c)) for i, c in enumerate(columns)]
    return both.select("bucket", F.array_compact(F.array(*differs)).alias("changed")).where(F.size("changed") > 0)


def cell_changes(old: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``<key>, column, change, before, after``: cells that differ between two tables, texts of the values beside them.

    ``change`` is ``changed``, ``added`` or ``removed``; of a row with a new or lost key every cell that holds something is
    listed. Columns of one table only and columns of another type count as cells of that table. Rows that share a key are
    matched in the order of their cells. NaN is missing, keys may be null.

    An order-free fingerprint per bucket of keys and column finds the buckets that differ; only their rows are joined, and
    only the columns that differ are compared. Two tables without a difference cost one aggregate of each.
    """
    key = [key] if isinstance(key, str) else list(key)
    clash = {"column", "change", "before", "after"} & set(key)
    if clash or not key:
        raise ValueError(f"a key must not be named {', '.join(sorted(clash))}" if clash else "name at least one key column")
    kinds = [{f.name: f.dataType for f in t.schema} for t in (old, new)]
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in key]
    null = F.lit(None).cast("string")
    old, new = (t.select(*[cell(k) for k in key], *[
        (present(t, c).cast("string") if c in own else null).alias(c) for c in columns]) for t, own in zip((old, new), kinds))
    schema = ", ".join([*(f"`{k}` {old.schema[k].dataType.simpleString()}" for k in key), "column string, change string, before string, after string"])
    if not columns:
        columns, old, new = ["_row"], old.withColumn("_row", F.lit("1")), new.withColumn("_row", F.lit("1"))
    buckets = freeze(changed_buckets(old, new, key, columns))
    touched = sorted({c for r in buckets.select(F.explode("changed").alias("c")).distinct().collect() for c in r})
    if not touched:
        return local_rows(old.sparkSession, [], schema)
    place = Window.partitionBy(*[f"k{i}" for i in range(len(key))]).orderBy(*[f"v{i}" for i in range(len(touched))])

    def rows(table: DataFrame) -> DataFrame:
        own = table.select(_bucket(table, key).alias("bucket"), *[cell(k).alias(f"k{i}") for i, k in enumerate(key)],
                           *[cell(c).alias(f"v{i}") for i, c in enumerate(touched)])
        own = own.join(F.broadcast(buckets.select("bucket")), "bucket", "left_semi")  # at most 65,536 rows
        return own.withColumn("place", F.row_number().over(place))

    a, b = rows(old).alias("a"), rows(new).alias("b")
    same = F.col("a.place") == F.col("b.place")
    for i in range(len(key)):
        same = same & F.col(f"a.k{i}").eqNullSafe(F.col(f"b.k{i}"))
    both = a.join(b, same, "full")
    lost, fresh = F.col("b.place").isNull(), F.col("a.place").isNull()
    cells = [F.when(~F.col(f"a.v{i}").eqNullSafe(F.col(f"b.v{i}")), F.struct(
        F.lit(c).alias("column"), F.when(lost, "removed").when(fresh, "added").otherwise("changed").alias("change"),
        F.col(f"a.v{i}").alias("before"), F.col(f"b.v{i}").alias("after"))) for i, c in enumerate(touched)]
    keys = [F.when(fresh, F.col(f"b.k{i}")).otherwise(F.col(f"a.k{i}")).alias(k) for i, k in enumerate(key)]
    return both.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*[cell(k) for k in key], "c.*")
