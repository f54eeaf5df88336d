"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, named, small, spread, texts_in_arrow, write_down
from .components import components

#: Variants are spread by multiplication with an odd number, which can be undone.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_GATHER = np.uint64(pow(int(_SPREAD), -1, 1 << 64))
#: Variants travel sorted: their 16 highest bits as counts, the rest in 6 bytes.
_PREFIX_BITS = 16
#: Variants of one task of the meeting.
_VARIANTS_EACH = 3_000_000
#: Fingerprints whose variants are built at a time.
_CHUNK = 1024


def fingerprint(text: bytes, words_each: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text: a bit is one where it is in over half of the shingles' XXH64."""
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    words = text.lower().split()  # of bytes: A-Z, and the six white-space characters of ASCII
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 16_384):
        end = min(n, start + 16_384)
        hashes = np.fromiter((hash_of(b" ".join(words[i:i + words_each]), seed) for i in range(start, end)),
                             "<u8", end - start)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            raws, marks = [], []
            for value in batch.column(1):
                text = (value.as_py() or "").encode()
                raws.append(xxhash.xxh64_intdigest(text, 42))
                marks.append(fingerprint(text, words_each))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (raws, marks))],
                names=["doc_id", "raw", "mark"])
    return run


def flips(distance: int) -> tuple[np.ndarray, int, int]:
    """Bit masks in order of size; how many of them the fingerprints with an odd and an even number of ones use.

    Two fingerprints at a distance of up to ``distance`` must share a variant. For an even distance both go half of
    it. For an odd one the rest is one bit: an odd distance only lies between an odd and an even number of ones, so
    the even side goes one bit further. At distance 3, two of any three bits lie in the same half of the word, so its
    two-bit masks need only join bits of one half.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the ball holds too many variants beyond a distance of 4")
    far = (distance + 1) // 2
    masks, count = [], []
    for size in range(far + 1):
        for bits in combinations(range(64), size):
            if not (distance == 3 and size == 2 and (bits[0] < 32) != (bits[1] < 32)):
                masks.append(sum(1 << b for b in bits))
        count.append(len(masks))
    return np.array(masks, np.uint64), count[distance // 2], count[far]


def _variants(distance: int, parts: int):
    """Rows ``part, packed``: the variants of up to ``_CHUNK`` fingerprints that meet in one part."""
    masks, few, many = flips(distance)
    prefixes = (1 << _PREFIX_BITS) // parts

    def pack(marks: np.ndarray) -> Iterator[tuple[int, bytes]]:
        odd = (np.bitwise_count(marks) & 1).astype(bool)
        spread_out, codes = [], []
        for own, n in ((marks[odd], few), (marks[~odd], many)):
            spread_out.append(((own[:, None] ^ masks[None, :n]) * _SPREAD).reshape(-1))
            codes.append(np.tile(np.arange(n, dtype="<u2"), len(own)))
        values, codes = np.concatenate(spread_out), np.concatenate(codes)
        order = np.argsort(values)
        values, codes = values[order], codes[order]
        counts = np.bincount((values >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64), minlength=1 << _PREFIX_BITS)
        ends = np.concatenate(([0], np.cumsum(counts)))
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        for part in range(parts):
            i, j = ends[part * prefixes], ends[(part + 1) * prefixes]
            if i < j:
                own = counts[part * prefixes:(part + 1) * prefixes].astype("<u4")
                yield part, own.tobytes() + low[i:j].tobytes() + codes[i:j].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(marks), _CHUNK):
                rows = list(pack(marks[start:start + _CHUNK]))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()),
                                                  pa.array([d for _, d in rows], pa.binary())], names=["part", "packed"])
    return run


def _meet(distance: int, parts: int):
    """Links between fingerprints that share a variant; all variants of a part are in one task, sorted by part."""
    masks, few, _ = flips(distance)
    prefixes = (1 << _PREFIX_BITS) // parts

    def unpack(part: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        counts = np.frombuffer(data, "<u4", prefixes)
        n = int(counts.sum())
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 4 * prefixes).reshape(n, 6)
        high = np.repeat(np.arange(part * prefixes, (part + 1) * prefixes, dtype=np.uint64), counts)
        values = wide.reshape(-1).view("<u8") | (high << np.uint64(64 - _PREFIX_BITS))
        return values, np.frombuffer(data, "<u2", n, 4 * prefixes + 6 * n)

    def links(part: int, packed: list[bytes]) -> pa.RecordBatch:
        pieces = [unpack(part, data) for data in packed]
        packed.clear()
        values, codes = (np.concatenate(x) for x in zip(*pieces))
        del pieces
        order = np.argsort(values)
        values = values[order]
        twice = values[1:] == values[:-1]
        shared = np.concatenate(([False], twice)) | np.concatenate((twice, [False]))
        values, codes = values[shared], codes[order[shared]].astype(np.int64)
        if not len(values):
            return pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        marks = (values * _GATHER) ^ masks[codes]
        first = np.concatenate(([True], values[1:] != values[:-1]))
        run = np.cumsum(first) - 1
        # All that reach this variant within the smaller radius are linked to each other and to those further out.
        near = np.where(codes < few, marks, np.uint64(0xFFFFFFFFFFFFFFFF))
        hub = np.minimum.reduceat(near, np.flatnonzero(first))
        any_near = np.logical_or.reduceat(codes < few, np.flatnonzero(first))
        hub, linked = hub[run], any_near[run]
        linked &= (hub != marks) & (np.bitwise_count(hub ^ marks) <= distance)
        pairs = np.unique(np.stack((hub[linked].view(np.int64), marks[linked].view(np.int64)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, data in zip(batch.column(0), batch.column(1)):
                if (part := part.as_py()) != now and held:
                    yield links(now, held)
                    held = []
                now = part
                held.append(data.as_py())
        if held:
            yield links(now, held)
    return run


def fingerprint_links(marks: DataFrame, distance: int = 3) -> DataFrame:
    """Links ``a, b`` between the distinct signed 64-bit fingerprints in the one column of ``marks``.

    Every fingerprint emits its variants (see ``flips``), they are shuffled by value, and those that meet are verified
    by their distance. A variant that many fingerprints reach gives a star around one of them, not all pairs: the
    stars connect whatever any link connects.
    """
    masks, few, many = flips(distance)
    rows = marks.count()
    parts = min(1 << _PREFIX_BITS, 1 << (spread(rows * (few + many) // 2, _VARIANTS_EACH, 64) - 1).bit_length())
    packed = marks.mapInArrow(_variants(distance, parts), "part int, packed binary").repartition(parts, "part")
    return packed.sortWithinPartitions("part").mapInArrow(_meet(distance, parts), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = 3,
                    distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Fingerprints link at ``distance`` or fewer differing bits; a component is what links connect, its id the smallest
    ``doc_id`` in it. Null counts as the empty text, whose fingerprint is zero and links like any other. A null id
    does not count for the smallest; a component of null ids only has a null id. Rows that repeat an id are rows of
    the same component where their texts say so. An empty table gives an empty result; other columns are not read.

    Copies meet in one fingerprint before anything is linked, so a large group of copies costs no more than one text.
    """
    return _components(docs, id_column, text_column, words_each, distance).drop("raw")


def _components(docs: DataFrame, id_column: str, text_column: str, words_each: int, distance: int) -> DataFrame:
    read = texts_in_arrow(docs).select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    rows = write_down(read.mapInArrow(_fingerprints(words_each), "doc_id long, raw long, mark long"), "simhash-rows")
    marks = write_down(rows.groupBy("mark").agg(F.min("doc_id").alias("first_id")), "simhash-marks")
    links = fingerprint_links(marks.select("mark"), distance)
    found = components(links).select(F.col("node").alias("mark"), "root")
    linked = found.join(marks, "mark")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(lowest, "root").select("mark", "least_id")
    ids = marks.join(linked, "mark", "left").select("mark", F.coalesce("least_id", "first_id").alias("component_id"))
    return rows.join(small(write_down(ids, "simhash-ids")), "mark").select(
        "doc_id", "raw", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = 3,
                     distance: int = 3) -> DataFrame:
    """``docs`` with only the row of the smallest id of each component; all columns stay, whatever their names.

    A document is its id: rows that repeat the id that stays, in the same component, stay with it. Rows without an id
    stay only where their component has no id at all.
    """
    row_id, raw, id_, raw_ = (free_name(docs.columns, n) for n in ("_id", "_raw", "_dropped_id", "_dropped_raw"))
    found = _components(docs, id_column, text_column, words_each, distance)
    dropped = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    dropped = write_down(dropped.select(F.col("doc_id").alias(id_), F.col("raw").alias(raw_)).distinct(), "simhash-gone")
    keyed = docs.withColumns({row_id: named(id_column).cast("long"),
                              raw: F.xxhash64(F.coalesce(named(text_column), F.lit("")))})
    same = F.col(row_id).eqNullSafe(F.col(id_)) & (F.col(raw) == F.col(raw_))
    return keyed.join(small(dropped), same, "left_anti").drop(row_id, raw)
