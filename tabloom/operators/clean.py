"""Cleaning: headers, junk rows, empty columns and rows, missing values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import WHITESPACE
from ..functions import cell as _named
from ..functions import free_name, normalise, present, strip

_NO_NAME = re.compile(r"^(?:|_c\d+|unnamed[:_ ]*\d*(?:_level_\d+)?)$", re.IGNORECASE)


def is_unnamed(name: str) -> bool:
    """Whether a header is missing or one that a reader made up."""
    return bool(_NO_NAME.match(name.strip()))


def snake_case(name: str) -> str:
    """``Unit Price (BRL)`` to ``unit_price_brl``; letters of any language stay."""
    spaced = re.sub(r"(?<=[a-zà-ÿ0-9])(?=[A-ZÀ-Þ])", "_", name.strip(WHITESPACE))
    return re.sub(r"[\W_]+", "_", spaced).strip("_").lower()


def clean_names(names: Sequence[str]) -> list[str]:
    """Snake case, ``column_{i}`` for missing names, ``_2``, ``_3`` for repeated ones."""
    result: list[str] = []
    for i, name in enumerate(names, 1):
        base = f"column_{i}" if is_unnamed(name) else (snake_case(name) or f"column_{i}")
        unique, k = base, 2
        while unique in result:
            unique, k = f"{base}_{k}", k + 1
        result.append(unique)
    return result


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def merged_header(rows: Sequence[Sequence[str | None]]) -> list[str]:
    """Column names from several header rows: a section title carries on to the right until the next one."""
    width = max(len(r) for r in rows)
    parts: list[list[str]] = [[] for _ in range(width)]
    for depth, row in enumerate(rows):
        carried = ""
        for i in range(width):
            cell = (row[i] if i < len(row) and row[i] is not None else "").strip(WHITESPACE)
            # Only the rows above the last hold merged section titles.
            carried = cell or (carried if depth < len(rows) - 1 else "")
            if carried:
                parts[i].append(carried)
    return [" ".join(p) for p in parts]


def blank(df: DataFrame, c: str) -> Column:
    """Whether a cell is null, NaN or blank."""
    text = present(df, c).cast("string")
    return text.isNull() | (strip(text) == "")


def filled_cells(df: DataFrame) -> Column:
    """Number of cells of a row that hold something."""
    filled = [F.when(blank(df, c), 0).otherwise(1) for c in df.columns]
    return F.aggregate(F.array(*filled), F.lit(0), lambda a, b: a + b)


def header_echo(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """Whether a row repeats the header: every cell equals its column's name, ignoring case and outer blanks."""
    labels = list(names or df.columns)
    same = F.lit(True)
    for c, label in zip(df.columns, labels, strict=True):
        same = same & F.coalesce(normalise(_named(c)) == label.strip(WHITESPACE).lower(), F.lit(False))
    return same


def drop_junk_rows(df: DataFrame, min_filled: int = 2, names: Sequence[str] | None = None) -> DataFrame:
    """Drop divider rows, with fewer than ``min_filled`` cells filled, and rows that repeat the header.

    A table of fewer columns than that keeps its rows.
    """
    needed = min_filled if len(df.columns) > min_filled else 1
    return df.where((filled_cells(df) >= needed) & ~header_echo(df, names))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every cell is null, NaN or blank."""
    return df.where(filled_cells(df) > 0)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns in which every cell is null, NaN or blank; one scan counts all of them."""
    counts = df.agg(*[F.count_if(~blank(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[_named(c) for i, c in enumerate(df.columns) if counts[f"n{i}"] > 0])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.withColumnsRenamed(dict(names))


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def merge_columns(df: DataFrame, columns: Sequence[str], output: str, sep: str = " ", drop: bool = True) -> DataFrame:
    """Join the texts of several columns, leaving nulls out; a row with nulls only gives null."""
    merged = F.concat_ws(sep, *[_named(c).cast("string") for c in columns])
    some = F.coalesce(*[_named(c).cast("string") for c in columns]).isNotNull()
    held = free_name([*df.columns, output], "_merged")
    result = df.withColumn(held, F.when(some, merged))
    result = result.drop(*columns) if drop else result.drop(output)
    return result.withColumnRenamed(held, output)


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(columns) if columns else None)


def fill_missing(df: DataFrame, values: Mapping[str, object] | None = None, method: str | None = None,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls and NaN by constants per column, or by each numeric column's ``mean``, ``min`` or ``max``.

    The statistics are taken over the cells that are not missing; they are one row, read by a scalar subquery.
    """
    if values:
        df = df.na.fill(dict(values))
    if method:
        if method not in ("mean", "min", "max"):
            raise ValueError("method must be mean, min or max")
        pick = {"mean": F.avg, "min": F.min, "max": F.max}[method]
        stats = df.agg(F.struct(*[pick(present(df, c)).alias(f"s{i}") for i, c in enumerate(columns or [])]).alias("s")).scalar()
        df = df.withColumns({c: F.coalesce(present(df, c), stats[f"s{i}"]) for i, c in enumerate(columns or [])})
    return df
