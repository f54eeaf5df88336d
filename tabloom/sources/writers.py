"""Writing tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes that a task copies into its place of one file, and that it holds while it does.
_PIECE, _BLOCK = 64 << 20, 1 << 20


def save_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", header: bool = True) -> None:
    """Write a folder of CSV (with headers unless told), TSV, JSON lines, XML, Parquet or ORC files, one per partition."""
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        # Timestamps as plain ISO text; quotes are doubled inside quoted cells, as the reader expects.
        moments = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        plain = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in moments})
        # White space around a cell is part of it, line breaks too.
        plain.write.mode(mode).options(header=header, sep="\t" if fmt == "tsv" else ",", quote='"', escape='"',
                                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "xml":
        writer.format("xml").options(rowTag="row", rootTag="rows").save(path)
    elif fmt in ("parquet", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}; choose csv, tsv, json, xml, parquet or orc")


def _copied(piece: tuple[str, int, int, str, int]) -> None:
    """Bytes of a file to their place in another one; a task that runs again writes the same."""
    source, start, size, target, at = piece
    with open(source, "rb") as read, os.fdopen(os.open(target, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as out:
        read.seek(start)
        out.seek(at)
        while size:
            block = read.read(min(size, _BLOCK))
            if not block:
                raise OSError(f"{source} is shorter than it was")
            out.write(block)
            size -= len(block)


def save_one_file(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a folder of a single CSV (with its header) or TSV file, without a task that takes all rows.

    The header and every partition become files of their own, which are joined in this order: by the file system if it
    can join files, as HDFS does without reading them, or, in a folder that machines share as ``file:``, by tasks that copy
    each to its place in the one file. Stores that can do neither, such as object stores, get it from a single task.
    """
    if fmt not in ("csv", "tsv"):
        raise ValueError(f"unsupported format {fmt!r} of one file; choose csv or tsv")
    spark = df.sparkSession
    context, kind = spark.sparkContext, spark._jvm.org.apache.hadoop.fs.Path
    place = kind(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    shared = fs.getUri().getScheme() == "file"
    if not shared and not fs.hasPathCapability(place, "fs.capability.paths.concat"):
        save_table(df.coalesce(1), path, fmt)
        return

    def files() -> list[tuple[str, int]]:
        found = [(f.getPath(), f.getLen()) for f in fs.listStatus(place)]
        return sorted((f.toString(), n) for f, n in found if not f.getName().startswith(("_", ".")))

    save_table(df.limit(0).coalesce(1), path, fmt)
    top = files()
    save_table(df, path, fmt, "append", header=False)
    rows = [f for f in files() if f not in top]
    if not shared:
        full = [kind(f) for f, n in rows if n]
        joined = context._gateway.new_array(kind, len(full))
        for i, f in enumerate(full):
            joined[i] = f
        if full:
            fs.concat(kind(top[0][0]), joined)
        for f, n in rows:
            if not n:
                fs.delete(kind(f), False)
        return
    # Hidden until it is whole. What a job has copied is deleted before the next one, so little is there twice.
    hidden, name = kind(place, "_one_file"), kind(place, f"part-00000.{fmt}")
    target, whole = fs.makeQualified(hidden).toUri().getPath(), 0
    parts = [*top, *rows]
    step = max(context.defaultParallelism, -(-len(parts) // 8))
    for batch in (parts[i:i + step] for i in range(0, len(parts), step)):
        pieces = []
        for f, n in batch:
            source = kind(f).toUri().getPath()
            pieces += [(source, k, min(_PIECE, n - k), target, whole + k) for k in range(0, n, _PIECE)]
            whole += n
        if pieces:
            context.parallelize(pieces, len(pieces)).foreach(_copied)
        for f, _ in batch:
            fs.delete(kind(f), False)
    if fs.getFileStatus(hidden).getLen() != whole:
        raise OSError(f"{path}: the executors do not share this folder")
    fs.rename(hidden, name)
