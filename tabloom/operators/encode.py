"""Categorical encodings: indicator columns, integer codes, relative frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import name_key, present, unlike_names
from .lookup import attach, value_counts, with_dense_codes


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Sorted distinct values; an error when there are more than ``limit``, as each becomes a column."""
    rows = df.select(present(df, column).alias("v")).where("v is not null").distinct()
    found = (rows if limit is None else rows.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"{column!r} has more than {limit} distinct values; use the long form instead of columns")
    return sorted(r[0] for r in found)


def add_columns(df: DataFrame, columns: dict) -> DataFrame:
    """Append columns in one projection; an existing name is an error rather than silently replaced."""
    key = name_key(df.sparkSession)
    taken = {key(c) for c in df.columns}
    clash = [c for c in columns if key(c) in taken]
    if clash:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    return df.select("*", *[c.alias(name) for name, c in columns.items()])


def encode_onehot(df: DataFrame, column: str, prefix: str | None = None, values: list | None = None,
                  max_columns: int | None = None) -> DataFrame:
    """Add a 0/1 column ``{prefix}_{value}`` per distinct value, in value order; missing cells are 0 everywhere.

    Names that the session cannot tell apart, such as those of ``High`` and ``high``, get ``_2``, ``_3``, … With
    ``max_columns`` more values than that are an error.
    """
    found = distinct_values(df, column, max_columns) if values is None else values
    stem = column if prefix is None else prefix
    names = unlike_names([f"{stem}_{v}" for v in found], name_key(df.sparkSession))
    value = present(df, column)
    return add_columns(df, {name: value.eqNullSafe(F.lit(v)).cast("int") for name, v in zip(names, found)})


def encode_label(df: DataFrame, column: str, output: str | None = None, **sizes) -> DataFrame:
    """Add the 0-based rank of each value among the sorted distinct values; a missing cell gives -1."""
    target = output or f"{column}_label"
    codes = with_dense_codes(value_counts(df, column))
    return attach(df, column, codes, "_code", target, missing=-1, **sizes)


def encode_frequency(df: DataFrame, column: str, output: str | None = None, **sizes) -> DataFrame:
    """Add each value's share of the cells that are not missing; a missing cell stays so."""
    target = output or f"{column}_frequency"
    counts = value_counts(df, column)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    shares = counts.withColumn("_share", F.col("_n") / F.lit(float(total)))
    return attach(df, column, shares, "_share", target, **sizes)


def encode_categorical(df: DataFrame, column: str, method: str = "onehot", prefix: str | None = None) -> DataFrame:
    """Encode by ``onehot``, ``label`` or ``frequency``."""
    if method == "onehot":
        return encode_onehot(df, column, prefix)
    if method in ("label", "frequency"):
        return {"label": encode_label, "frequency": encode_frequency}[method](df, column)
    raise ValueError(f"unknown method {method!r}; choose onehot, label or frequency")
