"""Records that reach over the pieces a file is split into, put together without reading a file as a whole.

The text source cuts a file into splits and these into pieces at one character. Whether a piece begins inside a quoted cell,
or how deep inside a JSON value, depends on all pieces before it. So the files are scanned twice:

1. every split reports where it would end if it began outside of quotes, and where if it began inside;
2. the driver composes these reports in file order, one small row per split, as many as it plans itself; every split then
   begins where the one before it ended and gives out its own records. Parts of a record that reaches over a split's end
   are few and meet in a grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of what a split gives out: a whole record, the end of one begun before, all of a split inside one, its begin.
WHOLE, END, MIDDLE, BEGIN = range(4)
_BOM = "\ufeff"

_QUOTED = re.compile(r'"[^"]*+(?:""[^"]*+)*+"')
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')


class CsvScanner:
    """Lines of CSV: a state is whether a quoted cell is open. Quotes inside a cell that begins without one are text."""

    delimiter = glue = "\n"

    def __init__(self, sep: str) -> None:
        self.sep, self.opening = sep, sep + '"'

    def step(self, line: str, inside: int) -> tuple[int, int]:
        if '"' not in line:
            return inside, 0
        at = 0
        if inside:
            if not (closing := _CLOSING.match(line)):
                return 1, 0
            at = line.find(self.sep, closing.end()) + 1
            if not at:
                return 0, 0
        while True:
            if line.startswith('"', at):
                if not (cell := _QUOTED.match(line, at)):
                    return 1, 0
                at = line.find(self.sep, cell.end()) + 1
            else:
                at = line.find(self.opening, at) + 1
            if not at:
                return 0, 0

    @staticmethod
    def base(_: str) -> int:
        return 0

    def records(self, lines: Iterator[str], inside: int, depth: int, base: int) -> Iterator[tuple[int, str]]:
        held: list[str] = []
        kind, begun = (END if inside else WHOLE), inside
        for line in lines:
            inside, _ = self.step(line, inside)
            if inside:
                held.append(line)
                continue
            if held:
                line = "\n".join([*held, line])
                held = []
            line = line.removesuffix("\r")
            if line or kind == END:
                yield kind, line
            kind, begun = WHOLE, 0
        if held:
            yield (MIDDLE if begun else BEGIN), "\n".join(held)

    @staticmethod
    def complete(inside: int, depth: int, cut: bool | None) -> bool:
        """A quote that is never closed makes the rest of the file one cell, as for other readers."""
        return True


_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_STRING_END = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)


class JsonScanner:
    """Text of JSON up to each closing brace: a state is whether a string is open, and how many values are.

    Records are objects at the top, or in an array at the top of the file, however they are laid out over lines.
    """

    delimiter, glue = "}", ""

    def step(self, piece: str, inside: int) -> tuple[int, int]:
        if inside:
            if not (closing := _STRING_END.match(piece)):
                return 1, 0
            piece = piece[closing.end():]
        if '"' in piece:
            piece = _STRING.sub("", piece)
            if (at := piece.find('"')) >= 0:
                piece = piece[:at]
                return 1, piece.count("{") + piece.count("[") - piece.count("]")
        return 0, piece.count("{") + piece.count("[") - piece.count("]") - 1

    @staticmethod
    def base(begin: str) -> int:
        """Depth of the records of a file, by its first character that is no blank."""
        return 1 if begin == "[" else 0

    def records(self, pieces: Iterator[str], inside: int, depth: int, base: int) -> Iterator[tuple[int, str]]:
        begun = inside or depth > base
        kind = END if begun else WHOLE
        held: list[str] = []
        for piece in pieces:
            if not held and kind == WHOLE:
                at = piece.find("{")
                between = piece if at < 0 else piece[:at]
                if between.strip(" \t\r\n,[]"):
                    raise ValueError(f"no JSON records: {between.strip()[:80]!r} stands between them")
                depth += between.count("[") - between.count("]")
                if at < 0:
                    continue  # after the last brace of the file
                if depth != base:
                    raise ValueError("JSON records of a file must all stand in arrays, or none")
                piece = piece[at:]
            held.append(piece + "}")
            inside, change = self.step(piece, inside)
            depth += change
            if not inside and depth <= base:
                yield kind, "".join(held)
                held, kind, begun = [], WHOLE, 0
        if held:
            yield (MIDDLE if begun else BEGIN), "".join(held)

    @staticmethod
    def complete(inside: int, depth: int, cut: bool | None) -> bool:
        """``step`` counts a closing brace after every piece; the last one may lack it (``cut``, None if not known)."""
        return not inside and depth in ((0, -1) if cut is None else (-1,) if cut else (0,))


Scanner = CsvScanner | JsonScanner


def _pieces(spark: SparkSession, files: list[str], scanner: Scanner) -> DataFrame:
    text = spark.read.option("lineSep", scanner.delimiter).text(files)
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("length"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Array]]:
    """Parts of batches that come from one split: ``file, block, length of the file, pieces``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        changes = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *changes], [*changes, batch.num_rows]):
            yield int(files[a]), int(blocks[a]), batch.column(3)[int(a)].as_py(), batch.column(0).slice(a, b - a)


def _reported(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "length", "end0", "change0", "end1", "change1", "bytes", "begin"]
        kinds = [pa.int64()] * 8 + [pa.string()]
        now, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*now, *state], kinds)], names=names)

        for file, block, length, values in _runs(batches):
            if (file, block, length) != now:
                if now:
                    yield row()
                now, state = (file, block, length), [0, 0, 1, 0, 0, ""]
            end0, change0, end1, change1, size, begin = state
            for piece in values.to_pylist():
                if not begin and block == 0:
                    begin = piece.lstrip(" \t\r\n" + _BOM)[:1]
                after, change = scanner.step(piece, end0)
                if end0 == end1:
                    end1, change1 = after, change1 + change
                else:
                    end1, other = scanner.step(piece, end1)
                    change1 += other
                end0, change0 = after, change0 + change
            size += len(values) + (pc.sum(pc.binary_length(values)).as_py() or 0)
            state = [end0, change0, end1, change1, size, begin]
        if now:
            yield row()
    return run


def _given_out(scanner: Scanner, starts: dict[tuple[int, int], tuple[int, int]], bases: dict[int, int], parts: bool):
    """Records of a task's splits, or the parts of those that reach over a split's end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(batches)
        ahead = next(runs, None)
        out: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                               names=["file", "block", "kind", "first", "record"])
            out.clear()
            return batch

        while ahead:
            file, block = ahead[:2]

            def lines() -> Iterator[str]:
                nonlocal ahead
                begin = block == 0
                while ahead and ahead[:2] == (file, block):  # noqa: B023
                    for piece in ahead[3].to_pylist():
                        yield piece.removeprefix(_BOM) if begin else piece
                        begin = False
                    ahead = next(runs, None)

            first = block == 0
            inside, depth = starts.get((file, block), (0, 0))
            for kind, record in scanner.records(lines(), inside, depth, bases.get(file, 0)):
                if (kind != WHOLE) == parts:
                    out.append((file, block, kind, first, record))
                    size += len(record)
                    if len(out) >= 5_000 or size > 8_000_000:
                        yield full()
                        size = 0
                first = False
        if out:
            yield full()
    return run


def records(spark: SparkSession, files: list[str], scanner: Scanner) -> DataFrame:
    """``record, first`` of each record of ``files``: its text, and whether it is the first one of its file.

    Every split of a file is a task of its own. The first scan runs at once, the second one with the result.
    """
    pieces = _pieces(spark, files, scanner)
    reports = pieces.mapInArrow(_reported(scanner), "file long, block long, length long, end0 long, "
                                "change0 long, end1 long, change1 long, bytes long, begin string")
    starts: dict[tuple[int, int], tuple[int, int]] = {}
    bases: dict[int, int] = {}
    sizes: dict[int, int] = {}
    lengths: dict[int, int] = {}
    state: dict[int, tuple[int, int]] = {}
    for r in sorted(reports.collect(), key=lambda r: (r["file"], r["block"])):
        inside, depth = state.get(r["file"], (0, 0))
        if r["block"] == 0 and (base := scanner.base(r["begin"])):
            bases[r["file"]] = base
        if inside or depth:
            starts[r["file"], r["block"]] = inside, depth
        end, change = (r["end1"], r["change1"]) if inside else (r["end0"], r["change0"])
        state[r["file"]] = end, depth + change
        sizes[r["file"]] = sizes.get(r["file"], 0) + r["bytes"]
        lengths[r["file"]] = r["length"]
    for file, (inside, depth) in state.items():
        # Every piece but the last ends with the delimiter; of compressed files the size says nothing.
        if not scanner.complete(inside, depth, {lengths[file]: False, lengths[file] + 1: True}.get(sizes[file])):
            paths = spark.read.text(files).select(F.col("_metadata.file_path").alias("path")).distinct()
            path = paths.filter(F.xxhash64("path") == file).first()[0]
            raise ValueError(f"{path}: the file ends inside a value")

    schema = "file long, block long, kind int, first boolean, record string"
    whole = pieces.mapInArrow(_given_out(scanner, starts, bases, False), schema).select("record", "first")
    if not starts:
        return whole
    # Two rows for a split at most; a record's parts are numbered by the split in which it begins.
    parts = pieces.mapInArrow(_given_out(scanner, starts, bases, True), schema)
    order = F.struct("block", "kind")
    before = Window.partitionBy("file").orderBy("block", "kind")
    parts = parts.withColumn("begun", F.last(F.when(F.col("kind") == BEGIN, F.col("block")), ignorenulls=True).over(before))
    joined = parts.groupBy("file", "begun").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col("record").alias("record")))).alias("parts"),
        F.bool_or(F.col("first") & (F.col("kind") == BEGIN)).alias("first"))
    return whole.unionByName(joined.select(F.array_join("parts.record", scanner.glue).alias("record"), "first"))
