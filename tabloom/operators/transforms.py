"""Column transforms on DataFrames. Each returns a new DataFrame; ``output`` defaults to replacing the column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx
from ..constants import MAX_ORDINAL_WORDS, TRUE_WORDS
from ..functions.dates import DATE_PARTS
from ..functions.ordinals import matching_scale


def to_boolean(df: DataFrame, column: str, true_values: Sequence[str] | None = None,
               output: str | None = None) -> DataFrame:
    """Text, number or boolean to boolean. A number is true when it equals a listed number (by default 1)."""
    return df.withColumn(output or column, boolean_column(df, column, true_values))


def boolean_column(df: DataFrame, column: str, true_values: Sequence[str] | None = None) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType) and true_values is None:
        return fx.cell(column)
    if isinstance(kind, T.NumericType):
        numbers = []
        for word in TRUE_WORDS if true_values is None else true_values:
            try:
                numbers.append(float(word))
            except ValueError:
                continue
        value = fx.cell(column).cast("double")
        return F.when(~F.isnan(value), value.isin(*numbers))
    return fx.boolean_from_text(fx.cell(column), true_values)


def parse_numeric_strings(df: DataFrame, column: str, decimal: str = ".", output: str | None = None) -> DataFrame:
    """Text such as ``$1,200`` or ``45%`` to double."""
    return df.withColumn(output or column, fx.numeric_from_text(fx.cell(column), decimal))


def parse_dates(df: DataFrame, column: str, fmt: str | None = None, day_first: bool = False,
                output: str | None = None) -> DataFrame:
    """Text to ``timestamp_ntz``, by an explicit strftime format or value by value."""
    explicit = fmt and fmt != "auto"
    parsed = fx.parse_dates_as(fx.cell(column), fmt) if explicit else fx.parse_dates(fx.cell(column), day_first)
    return df.withColumn(output or column, parsed)


def extract_date_features(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Add ``_year, _month, _day, _weekday, _hour``; text is parsed first."""
    kind = df.schema[column].dataType
    moment = fx.parse_dates(fx.cell(column)) if isinstance(kind, T.StringType) else fx.cell(column)
    if isinstance(kind, T.DateType):
        moment = moment.cast("timestamp_ntz")
    name = column if prefix is None else prefix
    held = fx.free_name([*df.columns, *(f"{name}_{part}" for part in DATE_PARTS)], "_moment")
    return (df.withColumn(held, moment)
            .withColumns({f"{name}_{part}": fx.date_part(F.col(held), part) for part in DATE_PARTS})
            .drop(held))


def bin_edges(df: DataFrame, column: str, bins: int | Sequence[float]) -> list[float]:
    """Explicit edges as they are, or equal widths over the column's range, for which one row is read.

    A column without values has no edges.
    """
    if not isinstance(bins, int):
        edges = [float(b) for b in bins]
        if sorted(set(edges)) != edges:
            raise ValueError("bin edges must increase")
        return edges
    x = number(column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return []
    if lo == float("-inf") or hi == float("inf"):
        raise ValueError("equal-width bins need finite values")
    return fx.equal_width_edges(lo, hi, bins)


def number(column: str) -> Column:
    """The column as double, with NaN as null."""
    value = fx.cell(column).cast("double")
    return F.when(~F.isnan(value), value)


def bin_numeric(df: DataFrame, column: str, bins: int | Sequence[float] = 5, labels: Sequence[str] | None = None,
                output: str | None = None) -> DataFrame:
    """Add the right-closed bin of each number, of equal widths or by explicit edges; outside gives null.

    The result is a label when ``labels`` are given, else a struct of the bin's number from 1, its lower and its upper
    edge.
    """
    edges = bin_edges(df, column, bins)
    if labels is not None and len(labels) != (bins if isinstance(bins, int) else len(edges) - 1):
        raise ValueError("as many labels as bins are needed")
    held = fx.free_name([*df.columns, output or f"{column}_bin"], "_bin")
    place = F.col(held)
    if labels is not None:
        # get, not element_at: under ANSI the latter claims never to be null, even for a null place.
        result = F.get(_constants(labels), place - 1)
    else:
        result = F.when(place.isNotNull(), F.struct(
            place.alias("bin"), F.get(_constants(edges[:-1]), place - 1).alias("lo"),
            F.get(_constants(edges[1:]), place - 1).alias("hi")))
    return (df.withColumn(held, fx.bin_index(number(column), edges))
            .withColumn(output or f"{column}_bin", result).drop(held))


def _constants(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<double>")


def normalize(df: DataFrame, column: str, method: str = "minmax", output: str | None = None) -> DataFrame:
    """Scale to 0..1 (``minmax``; a constant gives 0) or to mean 0 and deviation 1 (``zscore``; a constant gives null).

    The statistics are one row, read by a scalar subquery; there is no join and no shuffle of the data.
    """
    x = number(column)
    if method == "minmax":
        s = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()
        scaled = F.when(s["lo"] == s["hi"], x * 0.0).otherwise(F.try_divide(x - s["lo"], s["hi"] - s["lo"]))
    elif method == "zscore":
        s = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).alias("s")).scalar()
        scaled = F.try_divide(x - s["mean"], s["std"])
    else:
        raise ValueError(f"unknown method {method!r}; choose minmax or zscore")
    return df.withColumn(output or f"{column}_{method}", scaled)


def infer_ordinal_order(df: DataFrame, column: str) -> list[str] | None:
    """The known scale that covers the column's words, cut to the words present, or None."""
    words = (df.select(fx.normalise(fx.cell(column)).alias("w")).where("w is not null").distinct()
             .limit(MAX_ORDINAL_WORDS + 1))
    return words.agg(matching_scale(F.collect_set("w"))).first()[0]


def make_ordinal(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """Replace the column by its normalised level and add its 0-based ``{column}_rank``; words off the scale give null.

    The order is kept in the column's metadata. Without a given or known order the column stays as it is.
    """
    scale = list(order) if order is not None else infer_ordinal_order(df, column)
    if not scale:
        return df
    levels = [s.strip().lower() for s in scale]
    rank = fx.ordinal_rank(fx.cell(column), levels)
    level = F.when(rank.isNotNull(), fx.normalise(fx.cell(column)))
    return (df.withColumns({f"{column}_rank": rank, column: level})
            .withMetadata(column, {"ordinal_order": levels}))
