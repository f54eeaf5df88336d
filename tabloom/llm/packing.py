"""Packing documents into sequences of a fixed number of tokens: best-fit decreasing under certified bounds."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, remove_written, spread, texts_in_arrow, write_down

#: Pieces of a partition that are packed together at first and at most; partitions grow by the factor as they exchange.
EACH, MOST, GROWTH = 4_000, 256_000, 8
#: Values of a bound's parameter that are tried.
_PARAMETERS = 64
#: Characters whose classes are old enough that no two libraries differ about them.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


# ---- token ids ----------------------------------------------------------------------------------------------------

def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids by the ``tokenizers`` library, without special tokens.

    A byte-level file whose ids follow the order of its merges holds the same ranks as a rank file; texts of plain
    characters then go through the ``tiktoken`` library, which gives the same ids in a third of the time. All other texts,
    and all texts of files of another kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            ranks = self._ranks(json.load(file))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if (spec.get("normalizer") or model.get("type") != "BPE" or before.get("type") != "ByteLevel"
                or before.get("add_prefix_space") or not before.get("use_regex", True)
                or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        byte_of, special = _byte_characters(), {t["content"] for t in spec.get("added_tokens", ())}
        return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        slow = iter(self.own.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
                    if not all(plain) else ())
        return [np.array(self.fast.encode_ordinary(t) if p else next(slow).ids, "<u4") for t, p in zip(texts, plain)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process; the vocabulary file lies on every machine, as the tokenizers' package does."""
    return Encoder(path, pattern)


def _pieces(path: str, pattern: str, capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                out: list[tuple] = []
                for row, ids in enumerate(own.ids([t.as_py() or "" for t in part.column(1)])):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        raw = ids[a:b].tobytes()
                        out.append((row, piece, a, b - a, zlib.crc32(raw), raw if keep_ids else None))
                rows, *columns = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: each text's ids and ``end``, cut into pieces where too long.

    All pieces but the first of a document are full. ``ids`` (little-endian unsigned 32-bit numbers) is null unless kept.
    """
    read = texts_in_arrow(docs).select(named(id_column).alias("doc_id"), named(text_column).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_pieces(path, pattern, capacity, end, keep_ids), f"doc_id {kind}, piece long, start long, "
                           "length long, ids_crc32 long, ids binary")


# ---- packing ------------------------------------------------------------------------------------------------------

def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of ``lengths``, which fall: each goes where it leaves the least room.

    Open bins are stacked by their room, and one bit per room says whether there is any, so a search is one shift.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        if fitting := mask >> length:
            room = length + (fitting & -fitting).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, own = capacity, made
            made += 1
        bins[i], offsets[i] = own, capacity - room
        if left := room - length:
            rooms[left].append(own)
            mask |= 1 << left
    return bins, offsets


def fullest_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of ``lengths``, which fall: bins are filled one after another as far as any choice can.

    Each starts with the longest piece left. The sums that shorter ones reach are the bits of a number, longest first,
    until one fills the bin; walking back through them gives the pieces.
    """
    values, counts = np.unique(lengths, return_counts=True)
    left = dict(zip(values[::-1].tolist(), counts[::-1].tolist()))
    placed: dict[int, list[tuple[int, int]]] = {length: [] for length in left}
    made = 0
    while left:
        first = next(iter(left))
        room, sums, steps = capacity - first, 1, []
        for length, count in left.items():
            for _ in range(min(count - (length == first), room // length)):
                steps.append((length, sums))
                sums |= (sums << length) & ((1 << room + 1) - 1)
            if sums >> room & 1:
                break
        chosen, target = [first], sums.bit_length() - 1
        for length, before in reversed(steps):
            if not before >> target & 1:
                chosen.append(length)
                target -= length
        at = 0
        for length in chosen:
            placed[length].append((made, at))
            at += length
            left[length] -= 1
            if not left[length]:
                del left[length]
        made += 1
    order = [placed[length].pop() for length in lengths.tolist()]
    return np.array([b for b, _ in order], np.int64), np.array([o for _, o in order], np.int64)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by three families of dual-feasible functions over the histogram of lengths.

    A dual-feasible function maps lengths so that what fits a bin sums to one at most; so the sum over all pieces is a
    bound. The families: rounding to k-ths, keeping what lies between a threshold and its complement (what is larger
    fills a bin, what is smaller counts nothing), and counting small pieces in units of the threshold.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(lengths):
        return 0

    def bins(values: np.ndarray, one: np.ndarray | int) -> int:
        return int(np.max(-(-(values @ counts) // one)))

    best = bins(lengths, capacity)
    k = np.arange(1, _PARAMETERS)[:, None]
    whole = (k + 1) * lengths % capacity == 0
    best = max(best, bins(np.where(whole, k * lengths, (k + 1) * lengths // capacity * capacity), (k * capacity)[:, 0]))
    e = np.unique(np.minimum(lengths, capacity + 1 - lengths))
    e = e[(e >= 1) & (2 * e <= capacity)]
    if len(e) > 8 * _PARAMETERS:
        e = e[np.linspace(0, len(e) - 1, 8 * _PARAMETERS).astype(int)]
    if len(e):
        e = e[:, None]
        best = max(best, bins(np.where(lengths > capacity - e, capacity, np.where(lengths < e, 0, lengths)), capacity))
        units = capacity // e
        counted = np.where(2 * lengths > capacity, units - (capacity - lengths) // e, (lengths >= e).astype(np.int64))
        best = max(best, bins(counted, units[:, 0]))
    return best


def _packed(capacity: int, level: int):
    """Packs the pieces of one partition, certifies the number of bins and marks the pieces to exchange."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths, marks = (table[c].to_numpy() for c in ("length", "mark"))
        order = np.lexsort((marks, -lengths))
        bins, offsets = best_fit_decreasing(lengths[order], capacity)
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        if bins.max() + 1 > bound:
            other = fullest_bins(lengths[order], capacity)
            if other[0].max() < bins.max():
                bins, offsets = other
        fill = np.bincount(bins, lengths[order]).astype(np.int64)
        gap = len(fill) - bound
        # Without a gap only the emptiest bin can be saved, together with those of other partitions.
        loose = fill < capacity if gap else np.arange(len(fill)) == np.argmin(fill)
        sequence = (level << 52) + (key[0].as_py() << 20) + bins
        out = table.select([c for c in table.column_names if c not in _STATE]).take(pa.array(order))
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("gap", np.full(len(bins), gap)),
                             ("loose", (loose & (fill < capacity))[bins])):
            out = out.append_column(name, pa.array(values))
        return out
    return run


_STATE = ("part", "sequence_id", "offset", "gap", "loose")


def _pack_once(pieces: DataFrame, rows: int, capacity: int, level: int, each: int) -> DataFrame:
    parts = spread(rows, each)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.lit(level), F.col("mark")), F.lit(parts)))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in _STATE]
    schema = ", ".join([*kept, "sequence_id long", "offset long", "gap long", "loose boolean"])
    return write_down(dealt.groupBy("part").applyInArrow(_packed(capacity, level), schema), "packing-packed")


def _bins(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def global_bound(pieces: DataFrame, capacity: int) -> int:
    """``lower_bound`` of all pieces; the driver receives one count per length."""
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    return lower_bound(np.array([r["length"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), capacity)


def pack_pieces(pieces: DataFrame, capacity: int = 1024, each: int = EACH) -> DataFrame:
    """``pieces`` (a written table with ``mark`` and ``length``) with ``sequence_id`` and ``offset``.

    Full pieces are sequences by themselves. The others are dealt by a hash of ``mark``, about ``each`` to a partition,
    and packed there by best-fit decreasing; a lower bound certifies the partition's number of bins. Where it does not,
    bins filled one by one are tried as well (``fullest_bins``). Partitions that still have a gap give back the pieces of all bins that are not full, certified ones those of their emptiest bin; these pieces are
    dealt anew over fewer, larger partitions and packed again; an exchange that saves no bin does not count. It ends when
    the bins meet the bound of all their pieces, or when none is saved by partitions as large as they get (``MOST``).
    ``mark`` tells the pieces apart.
    """
    full = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("mark"), "offset": F.lit(0).cast("long")})
    done, held, held_bins, level = [full], None, 0, 0
    now = pieces.filter(F.col("length") < capacity)
    while rows := now.count():
        size = min(each * GROWTH**level, max(each, MOST))
        packed = _pack_once(now, rows, capacity, level, size)
        bins = _bins(packed)
        level += 1
        if held is not None and bins >= held_bins:
            remove_written(packed)
            if size >= min(rows, MOST):
                done.append(held)
                break
            continue
        held = packed.filter("loose")
        held_bins = _bins(held)
        if held_bins < 2 or bins == global_bound(packed, capacity):
            done.append(packed)
            break
        done.append(packed.filter("NOT loose"))
        now = held.select(*pieces.columns)
    names = [*pieces.columns, "sequence_id", "offset"]
    return reduce(DataFrame.unionByName, [d.select(*names) for d in done])


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False,
         id_column: str = "doc_id", text_column: str = "text", each: int = EACH) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    A document is its ids by the vocabulary file ``path`` and then ``end``; null counts as the empty text, which is one
    token. Only documents longer than ``capacity`` are cut. Every row of ``docs`` is a document of its own: ids may be
    null or repeat, and texts may. Pieces of one length are interchangeable, ties go to the lower number of the row.
    An empty table gives an empty result; other columns are not read. A sequence's offsets have no gaps.
    """
    pieces = token_pieces(docs, path, pattern, capacity, end, keep_ids, id_column, text_column)
    pieces = write_down(pieces.withColumn("mark", F.monotonically_increasing_id()), "packing-pieces")
    return pack_pieces(pieces, capacity, each).drop("mark")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, starts``: the packed token ids of a result of ``pack`` that kept them.

    ``starts`` are the offsets at which documents begin, for attention masks. A group is one sequence, bounded by its
    capacity.
    """
    own = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, s: F.concat(a, s["ids"]))
    return own.select("sequence_id", "n_tokens", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"),
                      F.col("p.offset").alias("starts"))
