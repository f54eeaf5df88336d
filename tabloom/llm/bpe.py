"""Byte-level BPE encoding and decoding with the rank files of public tokenizers."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, texts_in_arrow

#: White space as the pattern language of rank files means it (Unicode White_Space); Python's adds control characters.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Text between white space, with the space before it: no match of the pattern reaches over its ends.
_UNITS = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: Units and pieces remembered per worker in each of two generations, and the longest one remembered.
_UNITS_KEPT, _PIECES_KEPT, _LONGEST = 150_000, 300_000, 64
#: Units of a text that are held at a time.
_AT_ONCE = 200_000


class PerfectHash:
    """A minimal perfect hash: every key gets its own number below the number of keys.

    Keys go through levels of bit arrays; those alone at their place settle there, the others go on. A key's number is
    the count of set bits before its place. Other strings get any number, so the caller compares the key found there.
    """

    def __init__(self, hashes: np.ndarray, gamma: float = 1.5) -> None:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys share a hash")
        self.sizes: list[int] = []
        bits, left = [], hashes
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = self._place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for strings that settle nowhere."""
        found, start = np.full(len(hashes), -1), 0
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = start + self._place(hashes[open_], level, size)
            hit = self.bits[at]
            found[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
            start += size
            if not len(open_):
                break
        return found


class Remembered:
    """Ids by text in two generations: once the newer one is full it becomes the older one, which is forgotten."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def has(self, text: str) -> bool:
        """Whether ``new`` holds the text, if need be after moving it there."""
        if text in self.new:
            return True
        if (ids := self.old.get(text)) is not None:
            self.new[text] = ids
            return True
        return False

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}


class Codec:
    """Encodes and decodes with one rank file (lines of base64 token and rank) and one pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import xxhash

        self._hash = xxhash.xxh64_intdigest
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        keys = list(self.ranks)
        hashes = self._hashes(keys)
        self.perfect = PerfectHash(hashes)
        self.keys: list[bytes] = [b""] * len(keys)
        for key, number in zip(keys, self.perfect.numbers(hashes).tolist()):
            self.keys[number] = key
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACES}").replace(r"\S", f"[^{_SPACES}]")
                                    .replace(r"\s", f"[{_SPACES}]"))
        self.units, self.pieces_met = Remembered(_UNITS_KEPT), Remembered(_PIECES_KEPT)

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter((self._hash(k) for k in keys), np.uint64, len(keys))

    def merge(self, piece: bytes) -> list[int]:
        """The ranks of a piece that is no token: byte nodes are linked, a heap gives the next merge.

        The lowest rank goes first, the leftmost of equal ones. A node is named by its start; ``end`` is where it ends
        and the next one starts, ``pair`` the rank of joining the two. An entry of the heap is a rank and a node in
        one number; it is outdated if the node's pair has another rank by now.
        """
        n, rank_of = len(piece), self.ranks.get
        shift = n.bit_length()
        low = (1 << shift) - 1
        end = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [rank_of(piece[i:i + 2], -1) for i in range(n)]
        pair[n - 1] = -1
        heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            if pair[i] != entry >> shift:
                continue
            middle = end[i]
            pair[middle] = -1
            beyond = end[i] = end[middle]
            if beyond < n:
                before[beyond] = i
                pair[i] = rank = rank_of(piece[i:end[beyond]], -1)
                if rank >= 0:
                    heappush(heap, rank << shift | i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = rank = rank_of(piece[left:beyond], -1)
                if rank >= 0:
                    heappush(heap, rank << shift | left)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces not met lately: whole ones by the perfect hash, the rest merged."""
        texts = list(pieces)
        keys = [p.encode() for p in texts]
        ids = {}
        for text, key, number in zip(texts, keys, self.perfect.numbers(self._hashes(keys)).tolist()):
            whole = number >= 0 and self.keys[number] == key
            ranks = (self.ranks[key],) if whole else self.merge(key)
            ids[text] = struct.pack(f"<{len(ranks)}I", *ranks)
        return ids

    def _encode_units(self, units: list[str]) -> bytes:
        known = self.units.new
        unknown = [u for u in set(units) if not self.units.has(u)]
        if unknown:
            split = [self.pieces.findall(u) for u in unknown]
            have = self.pieces_met
            fresh = self._pieces({p for pieces in split for p in pieces if not have.has(p)})
            passing = {p: i for p, i in fresh.items() if len(p) > _LONGEST}
            have.new.update((p, i) for p, i in fresh.items() if len(p) <= _LONGEST)
            ids_of = passing.get if passing else None
            for unit, pieces in zip(unknown, split):
                if ids_of:
                    ids = b"".join([ids_of(p) or have.new[p] for p in pieces])
                else:
                    ids = b"".join([have.new[p] for p in pieces])
                known[unit] = ids
        out = b"".join([known[u] for u in units])
        for unit in unknown:
            if len(unit) > _LONGEST:
                del known[unit]
        self.units.turn()
        self.pieces_met.turn()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if len(text) < 4 * _AT_ONCE:
            return self._encode_units(_UNITS.findall(text))
        matches, out = _UNITS.finditer(text), []
        while units := [m.group() for m in islice(matches, _AT_ONCE)]:
            out.append(self._encode_units(units))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process; the rank file lies on every machine, as the tokenizer's package does."""
    return Codec(path, pattern)


def _sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _both(path: str, pattern: str, encoding: bool, decoding: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in _sliced(batches):
            given = batch.column(1)
            ids = [own.encode(t.as_py() or "") for t in given] if encoding else [i.as_py() or b"" for i in given]
            columns = {"doc_id": batch.column(0)}
            if encoding:
                columns |= {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoding:
                columns["decoded"] = pa.array([own.decode(i) for i in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
    return run


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` per row of ``docs``; ``ids`` holds little-endian unsigned 32-bit token ids.

    Null counts as the empty text and has no ids. Special tokens are ordinary text. Ids are kept as they are, nulls and
    repeated ones too, and need no order; an empty table gives an empty result; other columns are not read.

    Text between white space is encoded once while a worker remembers it. Its pieces by the pattern are looked up in
    the vocabulary by a minimal perfect hash; those that are no token are merged by a heap over linked bytes.
    """
    read = texts_in_arrow(docs).select(named(id_column).alias("doc_id"), named(text_column).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_both(path, pattern, True, False), f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded`` (bytes) per row of a result of ``encode``. Null ids give no bytes, unknown ones an error."""
    read = encoded.select("doc_id", "ids")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_both(path, pattern, False, True), f"doc_id {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass: ``doc_id, n_tokens, ids, decoded``."""
    read = texts_in_arrow(docs).select(named(id_column).alias("doc_id"), named(text_column).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_both(path, pattern, True, True), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def digests(trip: DataFrame) -> DataFrame:
    """SHA-256 of the ids and of the decoded bytes of ``round_trip``."""
    return trip.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
