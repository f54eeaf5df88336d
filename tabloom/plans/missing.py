"""Which columns are missing together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import blank
from ..session import local_rows

_BITS = 62
#: Patterns of which the sets of columns are derived on the driver, one small row each.
MOST_PATTERNS = 100_000


def _masks(df: DataFrame) -> list:
    """One whole number per 62 columns, a bit for each missing cell."""
    names, out = df.columns, []
    for start in range(0, len(names), _BITS):
        bits = [F.when(blank(df, c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(names[start:start + _BITS])]
        mask = bits[0]
        for bit in bits[1:]:
            mask = mask.bitwiseOR(bit)
        out.append(mask.alias(f"m{start // _BITS}"))
    return out


def _patterns(df: DataFrame) -> DataFrame:
    masks = _masks(df)
    names = [f"m{i}" for i in range(len(masks))]
    return df.select(*masks).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def missing_patterns(df: DataFrame) -> DataFrame:
    """``columns, n_missing, n, ratio``: each set of columns that exactly the same rows lack, and how many rows that is.

    Null, NaN and blank cells are missing. A row is cut down to one bit per column; only the different masks are shuffled.
    """
    patterns = _patterns(df)
    held = F.array(*[F.when(F.call_function("shiftright", F.col(f"m{i // _BITS}"), F.lit(i % _BITS)).bitwiseAND(F.lit(1).cast("long")) == 1, c)
                     for i, c in enumerate(df.columns)])
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return patterns.select(F.array_compact(held).alias("columns"), "n").select(
        "columns", F.size("columns").alias("n_missing"), "n", F.try_divide(F.col("n"), F.lit(total)).alias("ratio"))


def missing_together(df: DataFrame, min_share: float = 0.01) -> DataFrame:
    """``columns, n, ratio``: closed sets of at least two columns that at least ``min_share`` of the rows lack all of.

    A set is closed if no further column is missing in all of these rows; any other set is told by a closed one. Closed sets
    are the intersections of patterns. Columns missing in fewer rows than asked for are left out before patterns are
    formed, and patterns that differ in them count as one; should more than 100,000 be left, an error says so.
    """
    total = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(blank(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    least = max(1.0, min_share * total["n"])
    often = [c for i, c in enumerate(df.columns) if total[f"c{i}"] >= least]
    schema = "columns array<string>, n long, ratio double"
    if len(often) < 2:
        return local_rows(df.sparkSession, [], schema)
    rows = _patterns(df.select(*[f"`{c}`" for c in often])).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of missing cells; raise min_share or choose columns")
    patterns: dict[int, int] = {}
    for r in rows:
        mask = sum(m << (_BITS * i) for i, m in enumerate(r[:-1]))
        patterns[mask] = r["n"]

    def support(mask: int) -> int:
        return sum(n for p, n in patterns.items() if p & mask == mask)

    closed: dict[int, int] = {}
    fresh = {p for p in patterns if p.bit_count() > 1}
    while fresh:
        kept = {m: n for m in fresh if (n := support(m)) >= least}
        closed.update(kept)
        # An intersection has at least the rows of what it is made of, so rare sets may still lead to frequent ones.
        fresh = {m for a in fresh for b in patterns if (m := a & b).bit_count() > 1 and m not in closed and m not in fresh}
    out = [([c for i, c in enumerate(often) if m >> i & 1], n, n / total["n"]) for m, n in closed.items()]
    return local_rows(df.sparkSession, sorted(out, key=lambda r: (-r[1], r[0])), schema)
