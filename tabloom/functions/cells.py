"""Columns by their whole name, missing cells, names that are still free."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(name: str) -> Column:
    """A column by its whole name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, as NaN counts as missing; a negative zero equals zero."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(cell(name)), cell(name) + F.lit(0.0).cast(kind))
    return cell(name)


def name_key(spark: SparkSession) -> Callable[[str], str]:
    """What two column names must have in common for the session to take them for the same."""
    exact = spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    return str if exact else str.lower


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or that with a number, so that it is none of ``taken`` in any case."""
    lower, name, n = {t.lower() for t in taken}, wanted, 1
    while name.lower() in lower:
        n += 1
        name = f"{wanted}_{n}"
    return name


def unlike_names(names: Iterable[str], key: Callable[[str], str]) -> list[str]:
    """The names in order; one that is taken for an earlier one gets ``_2``, ``_3``, …"""
    result: list[str] = []
    seen: set[str] = set()
    for name in names:
        unique, n = name, 2
        while key(unique) in seen:
            unique, n = f"{name}_{n}", n + 1
        seen.add(key(unique))
        result.append(unique)
    return result
