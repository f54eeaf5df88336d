"""Exact deduplication by counting quotient filters."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, named, shuffle_partitions, small, spread, texts_in_arrow, write_down

_HEAD = struct.Struct("<qqqq")
#: Marks of a partition that are gathered before its filters are built, 8 bytes each.
MARKS = 1_000_000


def build_filter(fingerprints: np.ndarray, low_bits: int) -> bytes:
    """A counting quotient filter over the low ``low_bits`` bits of 64-bit fingerprints.

    A fingerprint is cut into a quotient (its bucket) and a remainder. Remainders are stored sorted by bucket and
    value; one bit per bucket says that it holds any, one bit per slot that a bucket's run ends there. Slots with a
    count above one are listed with it. Nothing is lost: ``read_filter`` gives back every fingerprint and its count.
    """
    values, counts = np.unique(fingerprints & np.uint64((1 << low_bits) - 1), return_counts=True)
    n = len(values)
    quotient_bits = min(max(int(n).bit_length(), 3), low_bits - 1)
    remainder_bits = low_bits - quotient_bits
    quotients = (values >> np.uint64(remainder_bits)).astype(np.int64)
    width = (remainder_bits + 7) // 8
    remainders = (values & np.uint64((1 << remainder_bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotients] = 1
    run_end = np.ones(n, np.uint8)
    run_end[:-1] = quotients[1:] != quotients[:-1]
    many = np.flatnonzero(counts > 1)
    return b"".join((_HEAD.pack(n, quotient_bits, remainder_bits, len(many)), np.packbits(occupied).tobytes(),
                     np.packbits(run_end).tobytes(), remainders.tobytes(),
                     many.astype("<i8").tobytes(), counts[many].astype("<i8").tobytes()))


def read_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted low bits in a filter and their counts."""
    n, quotient_bits, remainder_bits, n_many = _HEAD.unpack_from(data)
    at = _HEAD.size
    take = (1 << quotient_bits) // 8 or 1
    occupied = np.unpackbits(np.frombuffer(data, np.uint8, take, at))[:1 << quotient_bits]
    at += take
    take = (n + 7) // 8
    run_end = np.unpackbits(np.frombuffer(data, np.uint8, take, at))[:n]
    at += take
    width = (remainder_bits + 7) // 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    many = np.frombuffer(data, "<i8", n_many, at)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<i8", n_many, at + 8 * n_many)
    # The k-th occupied bucket owns the k-th run.
    run = np.concatenate(([0], np.cumsum(run_end)[:-1])).astype(np.int64)
    quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
    return (quotients << np.uint64(remainder_bits)) | wide.reshape(-1).view("<u8"), counts


def merge_filters(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Merge by sorted remainders; counts of equal fingerprints add up."""
    parts = [read_filter(f) for f in filters]
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(counts, first)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import xxhash

    for batch in batches:
        raws, marks, digests = [], [], []
        for text in batch.column(1):
            raw = (text.as_py() or "").encode()
            low = raw.lower()  # of bytes: A-Z only
            raws.append(xxhash.xxh64_intdigest(raw, 42))
            marks.append(xxhash.xxh64_intdigest(low) - (1 << 63))
            digests.append(hashlib.sha256(low).digest())
        raws = np.array(raws, np.uint64).view(np.int64)  # as Spark's xxhash64 gives it
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws), pa.array(marks, pa.int64()),
                                          pa.array(digests, pa.binary())], names=["doc_id", "raw", "mark", "digest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        # Some rows at a time: a batch counts rows, and texts may be long.
        for start in range(0, batch.num_rows, 256):
            low = [(t.as_py() or "").encode().lower() for t in batch.column(0)[start:start + 256]]
            marks = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in low]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(low, pa.binary())],
                                             names=["mark", "bytes"])


def _filters_of_partition(block_bits: int, at_once: int = MARKS):
    """Filters of a partition's marks, one per block; beyond ``at_once`` marks another set of them begins."""
    def give(held: list[np.ndarray]) -> pa.RecordBatch:
        marks = np.concatenate(held)
        marks.sort()
        blocks = (marks >> np.uint64(64 - block_bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        ends = [*starts[1:], len(blocks)]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(blocks[s]) for s in starts], pa.int32()),
             pa.array([build_filter(marks[s:e], 64 - block_bits) for s, e in zip(starts, ends)], pa.binary())],
            names=["block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # Marks are shifted to be signed; shifting back gives the unsigned fingerprint.
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(1 << 63))
            size += batch.num_rows
            if size >= at_once:
                yield give(held)
                held, size = [], 0
        if size:
            yield give(held)
    return run


def _repeated_of_block(block_bits: int):
    """Rows come sorted by block: merge one block's filters, give out the fingerprints with a count above one."""
    def give(block: int, filters: list[bytes]) -> pa.RecordBatch:
        values, counts = merge_filters(filters)
        again = counts > 1
        marks = (values[again] | np.uint64(block << (64 - block_bits))) - np.uint64(1 << 63)
        return pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(counts[again])],
                                          names=["mark", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now and held:
                    yield give(now, held)
                    held = []
                now = block
                held.append(data)
        if held:
            yield give(now, held)
    return run


def repeated_fingerprints(marks: DataFrame, rows: int) -> DataFrame:
    """``mark, n`` of every 64-bit fingerprint that occurs more than once in the one column of ``marks``.

    Each partition builds one filter per block of the fingerprint space (its highest bits) from all of its marks, a million
    at a time, so a fingerprint reaches the merge once per partition and million however often it occurs; blocks are small
    enough for a task at any number of rows.
    """
    block_bits = max(8, (spread(rows, 250_000) - 1).bit_length())
    filters = marks.mapInArrow(_filters_of_partition(block_bits), "block int, filter binary")
    merged = filters.repartition(max(shuffle_partitions(marks.sparkSession), spread(rows, 1_000_000)), "block")
    return merged.sortWithinPartitions("block").mapInArrow(_repeated_of_block(block_bits), "mark long, n long")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after lower-casing A-Z. Of equal texts the row with the largest id stays; a null id
    sorts below all others. Of rows that also share the id exactly one stays, and null counts as the empty text.
    An empty table gives an empty result; other columns are not read.

    Method: a fingerprint per row; a counting quotient filter per partition, merged without loss; only fingerprints
    counted more than once take part in the byte verification, which groups them by the whole normalised text. Equal
    texts meet in the map-side aggregate, so a group with a third of all rows shuffles one text per task. Two texts
    with the same fingerprint and the same SHA-256 would stop the job.
    """
    return _members(docs, id_column, text_column).drop("raw")


def _members(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    docs = texts_in_arrow(docs)
    keys = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text")) \
        .mapInArrow(_digests, "doc_id long, raw long, mark long, digest binary")
    keys = write_down(keys.withColumn("row", F.monotonically_increasing_id()), "dedup-keys")
    rows = keys.count()
    repeated = write_down(repeated_fingerprints(keys.select("mark"), rows), "dedup-repeated")
    wanted = small(repeated.select("mark"))

    # One number orders the rows of a group: id first, then the frozen row number. 18 digits hold 10^8 tasks of rows.
    lowest = F.lit(-(1 << 63)).cast("decimal(19,0)") - 1
    rank = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), lowest) * F.lit(10**18).cast("decimal(19,0)") + F.col("row")
    groups = (keys.join(wanted, "mark", "left_semi").groupBy("mark", "digest")
              .agg(F.max(rank).alias("best"), F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    texts = docs.select(named(text_column).alias("text")).mapInArrow(_texts, "mark long, bytes binary")
    verified = (texts.join(wanted, "mark", "left_semi").groupBy("mark", "bytes").agg(F.count("*").alias("n"))
                .select("mark", F.unhex(F.sha2("bytes", 256)).alias("digest"), "n")
                .groupBy("mark", "digest").agg(F.count("*").alias("texts"), F.sum("n").alias("n")))
    good = (F.col("texts") == 1) & (F.col("n") == F.col("group_size"))
    groups = groups.join(verified, ["mark", "digest"], "left").withColumn(
        "group_size", F.when(good, F.col("group_size")).otherwise(
            F.raise_error(F.lit("texts changed between two reads, or two of them share a SHA-256")).cast("long")))
    groups = write_down(groups.filter("group_size > 1").drop("texts", "n"), "dedup-groups")

    found = keys.join(small(groups), ["mark", "digest"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id", "raw", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (rank == F.col("best"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that ``duplicate_groups`` does not keep; all columns stay, whatever their names.

    Rows that share id and text cannot be told apart by them: where the kept row has such twins, all of them leave and
    one comes back.
    """
    row_id, raw, id_, raw_ = (free_name(docs.columns, n) for n in ("_id", "_raw", "_dropped_id", "_dropped_raw"))
    members = write_down(_members(docs, id_column, text_column).filter("group_size > 1")
                         .select("doc_id", "raw", "kept"), "dedup-members")
    dropped = write_down(members.filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("raw").alias(raw_))
                         .distinct(), "dedup-dropped")
    twins = members.filter("kept").join(dropped, F.col("doc_id").eqNullSafe(F.col(id_))
                                        & (F.col("raw") == F.col(raw_))).select(id_, raw_)
    twins = write_down(twins, "dedup-twins")
    keyed = docs.withColumns({row_id: named(id_column).cast("long"),
                              raw: F.xxhash64(F.coalesce(named(text_column), F.lit("")))})
    same = F.col(row_id).eqNullSafe(F.col(id_)) & (F.col(raw) == F.col(raw_))
    stay = keyed.join(small(dropped), same, "left_anti")
    if not twins.isEmpty():
        stay = stay.unionByName(keyed.join(small(twins), same, "left_semi").dropDuplicates([row_id, raw]))
    return stay.drop(row_id, raw)
