"""Tag columns: several values in one cell, held apart by a separator."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TAG_HIT_SHARE, TAG_MEAN_PARTS, TAG_SEPARATORS
from ..functions import cell, free_name, name_key, part_count, split_tags, tag_suffix
from ..session import freeze
from .encode import add_columns
from .lookup import BROADCAST_BYTES, BROADCAST_ROWS


#: Tags of a block in which pairs are formed, and places of the table in which pairs are counted by their hash.
PAIR_BLOCK, PAIR_SPOTS = 64, 1 << 20


def detect_tag_separator(df: DataFrame, column: str) -> str | None:
    """First separator that more than a quarter of the values contain and that gives 1.3 parts or more on average."""
    text = cell(column).cast("string")
    measures = [F.count(text).alias("n")]
    for i, sep in enumerate(TAG_SEPARATORS):
        measures += [F.count_if(F.contains(text, F.lit(sep))).alias(f"hits_{i}"),
                     F.avg(part_count(text, sep)).alias(f"parts_{i}")]
    row = df.agg(*measures).first()
    for i, sep in enumerate(TAG_SEPARATORS):
        if row["n"] and row[f"hits_{i}"] / row["n"] > TAG_HIT_SHARE and row[f"parts_{i}"] > TAG_MEAN_PARTS:
            return sep
    return None


def tags_long(df: DataFrame, column: str, sep: str | None, keep: list[str] | None = None) -> DataFrame:
    """One row per tag of each cell, with the ``keep`` columns beside it; cells without tags give no row."""
    return df.select(*([cell(c) for c in keep or []]), F.explode(split_tags(cell(column), sep)).alias("tag"))


def tag_vocabulary(df: DataFrame, column: str, sep: str | None) -> DataFrame:
    """All distinct tags as rows."""
    return tags_long(df, column, sep).distinct()


def explode_tags(df: DataFrame, column: str, sep: str | None = None, prefix: str | None = None,
                 vocabulary: list[str] | None = None, max_columns: int | None = None) -> DataFrame:
    """Add a 0/1 column ``{prefix}_{tag}`` per distinct tag and keep the original column.

    ``sep=None`` looks for the separator and falls back to whitespace. Tags whose column names coincide share one
    column, which is 1 when any of them is present; so do names that the session cannot tell apart. With
    ``max_columns`` more tags than that are an error: use ``tags_long`` or ``tag_frequency``.
    """
    if sep is None:
        sep = detect_tag_separator(df, column)
    if vocabulary is None:
        tags = tag_vocabulary(df, column, sep)
        rows = (tags if max_columns is None else tags.limit(max_columns + 1)).collect()
        if max_columns is not None and len(rows) > max_columns:
            raise ValueError(f"{column!r} holds more than {max_columns} tags; use the long form instead of columns")
        vocabulary = sorted(r[0] for r in rows)
    named = defaultdict(list)
    first: dict[str, str] = {}
    key = name_key(df.sparkSession)
    for tag in vocabulary:
        name = f"{column if prefix is None else prefix}_{tag_suffix(tag)}"
        named[first.setdefault(key(name), name)].append(tag)
    held = free_name([*df.columns, *named], "_tags")
    tags = F.col(held)
    indicators = {
        name: (F.array_contains(tags, same[0]) if len(same) == 1
               else F.arrays_overlap(tags, F.array(*[F.lit(t) for t in same]))).cast("int")
        for name, same in named.items()
    }
    return add_columns(df.withColumn(held, split_tags(cell(column), sep)), indicators).drop(held)


def tag_frequency(df: DataFrame, column: str, sep: str | None) -> DataFrame:
    """Number of rows that hold each tag: ``tag, n``."""
    tags = F.array_distinct(split_tags(cell(column), sep))
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tag_cooccurrence(df: DataFrame, column: str, sep: str | None, min_rows: int = 1) -> DataFrame:
    """Number of rows that hold both tags, for each pair of tags met in a row: ``tag_a < tag_b, n``; with ``min_rows`` only
    pairs that at least so many rows hold, exact.

    Rows with the same set of tags are counted before their pairs are formed, so copies of a row cost nothing. A set is
    cut into blocks of tags; a task gets two blocks and makes the pairs between them, so a long set is many tasks' work
    and its array travels once per block, not once per tag.

    With ``min_rows`` tags that fewer rows hold go first, as no pair with them can reach it. Then pairs are counted by a
    hash into a table of fixed size, map-side, and only pairs whose place in it reaches ``min_rows`` are counted one by one.
    """
    held = df.select(F.array_sort(F.array_distinct(split_tags(cell(column), sep))).alias("tags"))
    if min_rows > 1:
        held = _without_rare(held, min_rows)
    sets = held.where(F.size("tags") > 1).groupBy("tags").agg(F.count(F.lit(1)).alias("n"))
    if min_rows <= 1:
        return _pairs(sets).groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n"))
    sets = freeze(sets)
    spot = F.pmod(F.xxhash64("tag_a", "tag_b"), F.lit(PAIR_SPOTS)).cast("int").alias("spot")
    reached = _pairs(sets).groupBy(spot).agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows).select("spot")
    # A number for each of the fixed number of places at most.
    left = _pairs(sets).withColumn("spot", spot).join(F.broadcast(freeze(reached)), "spot", "left_semi")
    return left.groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)


def _without_rare(held: DataFrame, min_rows: int) -> DataFrame:
    """``tags`` without those that fewer than ``min_rows`` rows hold, where the others are few enough to travel to the tasks."""
    often = freeze(held.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") >= min_rows).select("tag"))
    size = often.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("tag") + 64), F.lit(0)).alias("bytes")).first()
    if size["n"] > BROADCAST_ROWS or size["bytes"] > BROADCAST_BYTES:
        return held
    words = frozenset(r["tag"] for r in often.collect())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[t for t in row if t in words] for row in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], names=["tags"])

    return held.mapInArrow(kept, "tags array<string>")


def _pairs(sets: DataFrame) -> DataFrame:
    """``n, tag_a, tag_b`` of each pair of each set of tags."""
    last = F.floor((F.size("tags") - 1) / PAIR_BLOCK).cast("int")
    firsts = sets.select("n", "tags", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    blocks = firsts.select("n", "i", F.explode(F.sequence("i", "last")).alias("j"), "tags").select(
        "n", (F.col("i") == F.col("j")).alias("same"), F.slice("tags", F.col("i") * PAIR_BLOCK + 1, PAIR_BLOCK).alias("a"),
        F.slice("tags", F.col("j") * PAIR_BLOCK + 1, PAIR_BLOCK).alias("b"))
    long = blocks.where(F.size("a") + F.size("b") > PAIR_BLOCK).repartition(F.xxhash64("a", "b"))
    short = blocks.where(F.size("a") + F.size("b") <= PAIR_BLOCK)
    return long.unionAll(short).select("n", "same", F.explode("a").alias("tag_a"), "b") \
        .select("n", "same", "tag_a", F.explode("b").alias("tag_b")).where(~F.col("same") | (F.col("tag_a") < F.col("tag_b")))
