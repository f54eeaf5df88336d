"""The tables behind charts: distributions, crosstabs, shares, histograms, correlations, trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bin_index, cell, free_name, ordinal_rank, present
from ..session import local_rows
from .correlation import correlations
from .encode import distinct_values
from .transforms import bin_edges, infer_ordinal_order, number


_PAIRS_OF_AN_AGGREGATE = 100


def key_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the row count and count, sum, mean, min and max of each numeric column, in one scan."""
    measures: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        x = number(c)
        measures += [F.count(x).alias(f"{c}_count"), F.sum(x).alias(f"{c}_sum"), F.avg(x).alias(f"{c}_mean"),
                     F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return df.agg(*measures)


def group_summary(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows per group and count, mean, deviation, min and max of each numeric column."""
    measures: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        x = number(c)
        measures += [F.count(x).alias(f"{c}_count"), F.avg(x).alias(f"{c}_mean"),
                     F.stddev_samp(x).alias(f"{c}_std"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return df.groupBy(*[present(df, c).alias(c) for c in by]).agg(*measures)


def value_distribution(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """``value, n, share`` per distinct value. The total is summed from the counts, not from the rows."""
    values = df.select(present(df, column).alias("value"))
    rows = values.where("value is not null") if dropna else values
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n, share`` of several columns from one scan."""
    long = df.select(*[present(df, c).cast("string").alias(c) for c in columns]).unpivot(
        [], [cell(c) for c in columns], "column", "value")
    counts = (long.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    # One total per column, as many rows as the table has columns.
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return (counts.join(F.broadcast(totals), "column")
            .select("column", "value", "n", (F.col("n") / F.col("total")).alias("share")))


def share_by_group(df: DataFrame, group: str | Column, value: str | Column) -> DataFrame:
    """``group, value, n, share``: the share of each value within its group; null values are left out."""
    named = df.select((present(df, group) if isinstance(group, str) else group).alias("group"),
                      (present(df, value) if isinstance(value, str) else value).alias("value"))
    named = named.select(present(named, "group").alias("group"), present(named, "value").alias("value"))
    counts = named.where("value is not null").groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col("group").alias("_group")).agg(F.sum("n").alias("_total"))
    return (counts.join(totals, F.col("group").eqNullSafe(F.col("_group")))
            .select("group", "value", "n", (F.col("n") / F.col("_total")).alias("share")))


def crosstab_long(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of each pair of values that occurs: the heat-map table."""
    both = _present_pairs(df, rows, columns)
    return both.groupBy(cell(rows), cell(columns)).agg(F.count(F.lit(1)).alias("n"))


def _present_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(present(df, a).alias(a), present(df, b).alias(b))
    return both.where(cell(a).isNotNull() & cell(b).isNotNull())


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence | None = None,
             max_columns: int | None = None) -> DataFrame:
    """One row per value of ``rows`` and one count column per value of ``columns``; pairs that do not occur are 0.

    With ``max_columns`` more values of ``columns`` than that are an error.
    """
    found = list(values) if values is not None else distinct_values(df, columns, max_columns)
    wide = free_name([rows, *map(str, found)], "_column")
    both = _present_pairs(df, rows, columns).select(cell(rows), cell(columns).alias(wide))
    return both.groupBy(cell(rows)).pivot(wide, found).count().na.fill(0, [str(v) for v in found] or None)


def histogram(df: DataFrame, column: str, bins: int | Sequence[float] = 10) -> DataFrame:
    """``bin, lo, hi, n``; bins without values are listed with 0."""
    edges = bin_edges(df, column, bins)
    counts = (df.select(bin_index(number(column), edges).alias("_bin")).where("_bin is not null")
              .groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")))
    frame = local_rows(df.sparkSession, [(i + 1, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))],
                       "bin int, lo double, hi double")
    return (frame.join(counts, F.col("bin") == F.col("_bin"), "left")
            .select("bin", "lo", "hi", F.coalesce("_n", F.lit(0)).alias("n")))


def scatter_sample(df: DataFrame, x: str, y: str, cap: int | None = None, key: Sequence[str] | None = None,
                   seed: int = 42) -> DataFrame:
    """The points of a scatter plot: all of them, or with ``cap`` a sample of that many.

    With ``key`` columns the points are those with the smallest seeded hash, the same for every partitioning. Without,
    each row draws a seeded random number. Either way each task keeps ``cap`` rows only.
    """
    keys = [cell(k) for k in key or []]
    points = df.select(*keys, present(df, x).alias(x), present(df, y).alias(y)).where(
        cell(x).isNotNull() & cell(y).isNotNull())
    if cap is None:
        return points
    if key:
        order = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))
        return points.orderBy(order, *keys).limit(cap)
    return points.orderBy(F.rand(seed)).limit(cap)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``x, y, r``: Pearson correlation of every pair of columns, both ways and with itself, over the rows where both
    have a value.

    Few pairs are expressions of one aggregate; more go through ``correlations``, still in one scan.
    """
    pairs = [(c, c) for c in columns] + list(combinations(columns, 2))
    if len(pairs) > _PAIRS_OF_AN_AGGREGATE:
        return correlations(df, columns)
    row = df.agg(*[F.corr(number(a), number(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"r{i}").alias("r")))
    return row.select(F.inline(F.array(*cells)))


def _periods_between(first: Column, last: Column, grain: str) -> Column:
    """Number of steps of a grain from one period's start to another's."""
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    if grain in ("year", "quarter", "month"):
        return F.floor(months / {"year": 12, "quarter": 3, "month": 1}[grain])
    days = F.datediff(last, first)
    if grain == "hour":
        return days.cast("long") * 24 + F.hour(last) - F.hour(first)
    return F.floor(days / (7 if grain == "week" else 1))


GRAINS = {"year": "1 year", "quarter": "3 months", "month": "1 month", "week": "7 days", "day": "1 day",
          "hour": "1 hour"}


def period_of(moment: Column, grain: str) -> Column:
    """Start of the period of a local time; no step goes through the session time zone."""
    local = moment.cast("timestamp_ntz")
    if grain == "hour":
        return local.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(local))
    day = local.cast("date")
    return (day if grain == "day" else F.trunc(day, grain)).cast("timestamp_ntz")


def time_trend(df: DataFrame, moment: str, grain: str = "month", value: str | None = None,
               fill: bool = False) -> DataFrame:
    """``period, n`` and, with ``value``, its ``total`` and ``mean`` per period; ``fill`` lists empty periods with 0."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; choose from {', '.join(GRAINS)}")
    period = period_of(cell(moment), grain).alias("period")
    measures = [F.count(F.lit(1)).alias("n")]
    if value:
        measures += [F.sum(number(value)).alias("total"), F.avg(number(value)).alias("mean")]
    trend = df.where(cell(moment).isNotNull()).groupBy(period).agg(*measures)
    if not fill:
        return trend
    first, last, periods = trend.agg(
        F.min("period"), F.max("period"), _periods_between(F.min("period"), F.max("period"), grain)).first()
    if first is None:
        return trend.withColumn("total", F.coalesce("total", F.lit(0.0))) if value else trend
    start = F.lit(first).cast("timestamp_ntz")
    amount, unit = GRAINS[grain].split()
    step = {"year": "make_ym_interval(id * {n}, 0)", "months": "make_ym_interval(0, id * {n})",
            "month": "make_ym_interval(0, id * {n})", "days": "make_dt_interval(id * {n})",
            "day": "make_dt_interval(id * {n})", "hour": "make_dt_interval(0, id * {n})"}[unit].format(n=amount)
    # A range of numbers is made where it is needed, in as many tasks as the session has.
    frame = df.sparkSession.range(periods + 1).select(
        (start + F.expr(step.replace("id *", "cast(id as int) *"))).alias("period"))
    filled = frame.join(trend, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("total", F.coalesce("total", F.lit(0.0))) if value else filled


def ordinal_distribution(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """``rank, level, n, share`` in scale order, listing levels that do not occur; values off the scale are left out."""
    scale = list(order) if order is not None else infer_ordinal_order(df, column)
    if not scale:
        raise ValueError(f"no known scale for {column!r}; pass an order")
    counts = (df.select(ordinal_rank(cell(column), scale).alias("_rank")).where("_rank is not null")
              .groupBy("_rank").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).scalar()
    levels = local_rows(df.sparkSession, [(i, s.strip().lower()) for i, s in enumerate(scale)],
                        "rank int, level string")
    n = F.coalesce("_n", F.lit(0))
    return (levels.join(counts, F.col("rank") == F.col("_rank"), "left")
            .select("rank", "level", n.alias("n"), F.try_divide(n, total).alias("share"))
            .orderBy("rank"))


def filter_in(df: DataFrame, choices: Mapping[str, Sequence]) -> DataFrame:
    """Keep rows whose columns hold one of the chosen values; an empty choice keeps everything."""
    for column, values in choices.items():
        if values:
            df = df.where(cell(column).isin(*values))
    return df
