"""Exact quantiles of very large groups in two scans.

``percentile`` holds every distinct value of a group in one task. Here the first scan sketches each group (KLL, which merges
map-side), and the sketch gives an interval that holds the wanted rank but for a tiny chance. The second scan counts what
lies below and between the intervals and keeps the values inside them with their counts, about a hundredth of the rows.
Whether a rank really is inside its interval shows there; if it is not, or if an interval holds more values than are to be
kept, it is narrowed: each further pass counts a group's values in equal-width bins of the interval, and the next one looks
only into the bin that holds the rank. Every bin reports its own smallest and largest value, so intervals shrink to real
values. An interval that still spans several orders of magnitude is cut evenly by magnitude in every other pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cell, present
from ..session import freeze, local_rows

BINS = 1024
MAX_GROUPS = 500
MAX_BRANCHES = 64       # intervals up to which they are constants of the plan instead of a joined table
SKETCH, ERROR = 2048, 0.006     # size of a sketch, about 33 kB, and three times its error as a share of the rows
KEEP = 5_000_000        # values of a group that are kept in the second scan; beyond them bins are


def _position(p: float, n: int) -> tuple[int, int, float]:
    """Lower rank, upper rank and weight of the upper one, for linear interpolation among ``n`` sorted values."""
    place = p * (n - 1)
    lower = math.floor(place)
    return lower, min(math.ceil(place), n - 1), place - lower


def group_quantiles(df: DataFrame, probs: Sequence[float], group: str = "g", value: str = "x",
                    groups: int | None = None) -> DataFrame:
    """``(group, n, mean, std, min, max, q0, q1, …)`` per group of the double column ``value``, with linear interpolation.

    Nulls and NaN are left out. ``groups`` tells how many groups there are at most; if it is not known, a scan of the group
    column finds whether there are more than ``MAX_GROUPS``. With more only the large ones are sketched; the others are
    sorted within their group.
    """
    spark = df.sparkSession
    x = cell(value)
    clean = df.select(cell(group).alias("g"), x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    # Kind of the group column, to hand it back unchanged.
    kind = clean.schema["g"].dataType.simpleString()
    fields = ", ".join(["g " + kind, "n long", "mean double", "std double", "min double", "max double", *[f"q{i} double" for i in range(len(probs))]])

    inf = float("inf")
    finite = F.when((F.col("x") > -inf) & (F.col("x") < inf), F.col("x"))
    figures = [
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.min(finite).alias("lo"), F.max(finite).alias("hi"),
        F.count_if(F.col("x") == -inf).alias("below"), F.count(finite).alias("inside")]
    if groups is None:
        groups = clean.select("g").distinct().limit(MAX_GROUPS + 1).count()
    if groups > MAX_GROUPS:
        return freeze(_many_groups(clean, clean.groupBy("g").agg(*figures), probs)).withColumnRenamed("g", group)
    ends = sorted({e for p in probs for e in (max(0.0, p - ERROR), min(1.0, p + ERROR))})
    sketched = clean.groupBy("g").agg(*figures, F.kll_sketch_agg_double(finite, F.lit(SKETCH)).alias("sketch"))
    at_ends = F.when(F.col("inside") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(e) for e in ends])))
    stats = sketched.withColumn("ends", at_ends).drop("sketch").collect()

    found: dict[tuple, float] = {}      # (group, rank) -> value
    # (group, lo, hi, whether to cut by magnitude) -> [(rank, rank within the interval)]
    pending: dict[tuple, list] = {}
    brackets: dict = {}                 # group -> (disjoint intervals in order, whether to keep values, wanted ranks)
    for r in stats:
        ranks = {rank for p in probs for rank in _position(p, r["n"])[:2]}
        for rank in ranks:
            if rank < r["below"]:
                found[r["g"], rank] = -inf
            elif rank >= r["below"] + r["inside"]:
                found[r["g"], rank] = inf
            elif r["lo"] == r["hi"]:
                found[r["g"], rank] = r["lo"]
            elif r["inside"] < r["n"]:
                pending.setdefault((r["g"], r["lo"], r["hi"], False), []).append((rank, rank - r["below"]))
        if r["lo"] != r["hi"] and r["inside"] == r["n"]:
            of_end = dict(zip(ends, r["ends"])) | {0.0: r["lo"], 1.0: r["hi"]}
            pairs = sorted((of_end[max(0.0, p - ERROR)], of_end[min(1.0, p + ERROR)]) for p in probs)
            brackets[r["g"]] = _disjoint(pairs), 2 * ERROR * len(probs) * r["n"] <= KEEP, ranks
    if brackets:
        for key, wanted in _keep(clean, brackets, found, kind).items():
            pending.setdefault(key, []).extend(wanted)
    while pending:
        pending = _narrow(clean, pending, found, kind)

    rows = []
    for r in stats:
        out = [r["g"], r["n"], r["mean"], r["std"], r["min"], r["max"]]
        for p in probs:
            low, high, weight = _position(p, r["n"])
            a, b = found[r["g"], low], found[r["g"], high]
            out.append(a if weight == 0 or a == b else a + (b - a) * weight)
        rows.append(tuple(out))
    return local_rows(spark, rows, fields).withColumnRenamed("g", group)


def _disjoint(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted intervals, those that overlap as one."""
    out: list[tuple[float, float]] = []
    for low, high in pairs:
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def _keep(clean: DataFrame, brackets: dict, found: dict, kind: str) -> dict:
    """The second scan: put the answers into ``found`` and return the intervals of ranks that are still open.

    The intervals cut a group into zones; odd ones are intervals. Of a zone between them only a count, the smallest and the
    largest value are kept, of an interval every value, or every bin where a group is too large for that.
    """
    x, g = F.col("x"), F.col("g")
    if len(brackets) <= MAX_BRANCHES:
        chain = {"zone": F, "low": F, "high": F, "keep": F}
        for key, (intervals, keep, _) in brackets.items():
            own = g.eqNullSafe(F.lit(key).cast(kind))
            passed = [(x >= low).cast("int") + (x > high).cast("int") for low, high in intervals]
            chain["zone"] = chain["zone"].when(own, sum(passed[1:], passed[0]))
            chain["keep"] = chain["keep"].when(own, F.lit(keep))
            for i, name in enumerate(("low", "high")):
                chain[name] = chain[name].when(own, F.array(*[F.lit(v[i]) for v in intervals]))
        cut = clean.withColumns(chain)
    else:
        rows = [(key, [low for low, _ in intervals], [high for _, high in intervals], keep)
                for key, (intervals, keep, _) in brackets.items()]
        edges = local_rows(clean.sparkSession, rows, f"bg {kind}, low array<double>, high array<double>, keep boolean")
        # At most MAX_GROUPS rows.
        cut = clean.join(F.broadcast(edges), g.eqNullSafe(F.col("bg"))).withColumn(
            "zone", F.size(F.filter("low", lambda e: x >= e)) + F.size(F.filter("high", lambda e: x > e)))
    cut = cut.where("zone is not null")
    place = F.floor(F.col("zone") / 2).cast("int")
    low, high = F.get(F.col("low"), place), F.get(F.col("high"), place)
    if all(keep for _, keep, _ in brackets.values()):
        slot = F.when(F.col("zone") % 2 == 1, x)
    else:
        even = F.coalesce(F.try_divide(x / 2 - low / 2, high / 2 - low / 2), F.when(x == low, 0.0).otherwise(1.0))
        binned = F.least(F.floor(even * BINS), F.lit(BINS - 1)).cast("double")
        slot = F.when(F.col("zone") % 2 == 1, F.when(F.col("keep"), x).otherwise(binned))
    counted = (cut.select("g", "x", "zone", slot.alias("slot")).groupBy("g", "zone", "slot")
               .agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    upto = F.sum("k").over(Window.partitionBy("g").orderBy("zone", "slot"))
    wanted = local_rows(clean.sparkSession, [(key, rank) for key, (_, _, ranks) in brackets.items() for rank in ranks],
                        f"wg {kind}, rank long")
    hits = (counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("k"))
            .join(F.broadcast(wanted), g.eqNullSafe(F.col("wg")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
            .select("g", "rank", "before", "upto", "lo", "hi").collect())
    still_open: dict[tuple, list] = {}
    for h in hits:
        if h["lo"] == h["hi"] or h["rank"] == h["before"]:
            found[h["g"], h["rank"]] = h["lo"]
        elif h["rank"] == h["upto"] - 1:
            found[h["g"], h["rank"]] = h["hi"]
        else:
            key = h["g"], h["lo"], h["hi"], _spans_magnitudes(h["lo"], h["hi"])
            still_open.setdefault(key, []).append((h["rank"], h["rank"] - h["before"]))
    return still_open


def _many_groups(clean: DataFrame, stats: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Groups with more than a ``MAX_GROUPS``-th of the rows (fewer than ``MAX_GROUPS``) by narrowing, the rest by sorting."""
    sizes = freeze(stats.select("g", "n", "mean", "std"))
    total = sizes.agg(F.sum("n")).first()[0]
    large = sizes.where(F.col("n") * MAX_GROUPS > total).select(F.col("g").alias("lg"))
    is_large = F.col("g").eqNullSafe(F.col("lg"))
    by_sorting = _sorted_quantiles(clean.join(F.broadcast(large), is_large, "left_anti"), probs)
    moments = sizes.select(F.col("g").alias("mg"), "mean", "std")
    by_sorting = (by_sorting.join(moments, F.col("g").eqNullSafe(F.col("mg")))
                  .select("g", "n", "mean", "std", "min", "max", *[f"q{i}" for i in range(len(probs))]))
    if not large.take(1):
        return by_sorting
    by_narrowing = group_quantiles(clean.join(F.broadcast(large), is_large, "left_semi"), probs, groups=MAX_GROUPS)
    return by_sorting.unionByName(by_narrowing)


def _sorted_quantiles(clean: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Running counts over the distinct values of each group, in one shuffle by group after the values are counted."""
    counted = clean.groupBy("g", "x").agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("g")
    ranked = (counted.withColumn("upto", F.sum("k").over(whole.orderBy("x")))
              .withColumn("n", F.sum("k").over(whole)).withColumn("before", F.col("upto") - F.col("k")))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("before")) & (rank < F.col("upto")), F.col("x")))

    ends, quantile = [], []
    for i, p in enumerate(probs):
        place = F.lit(p) * (F.col("n") - 1)
        ends += [value_at(F.floor(place)).alias(f"a{i}"), value_at(F.ceil(place)).alias(f"b{i}")]
        a, b, weight = F.col(f"a{i}"), F.col(f"b{i}"), place - F.floor(place)
        quantile.append(F.when((weight == 0) | (a == b), a).otherwise(a + (b - a) * weight).alias(f"q{i}"))
    return (ranked.groupBy("g").agg(F.max("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), *ends)
            .select("g", "n", "min", "max", *quantile))


def _narrow(clean: DataFrame, pending: dict, found: dict, kind: str) -> dict:
    """One pass: put the answers met into ``found`` and return the narrower intervals that are still open."""
    spark = clean.sparkSession
    intervals = list(pending)
    wanted = [(i, sorted({place for _, place in pending[key]})) for i, key in enumerate(intervals)]
    places = local_rows(spark, [(i, place) for i, ps in wanted for place in ps], "i int, place long")

    # The intervals of a group are disjoint, so a value falls into one of them at most.
    if len(intervals) <= MAX_BRANCHES:
        chosen = F
        for i, (g, low, high, _) in enumerate(intervals):
            chosen = chosen.when(F.col("g").eqNullSafe(F.lit(g).cast(kind)) & F.col("x").between(low, high), i)
        inside = clean.select("x", chosen.alias("i")).where("i is not null")
        for name, part in (("lo", 1), ("hi", 2), ("by_magnitude", 3)):
            inside = inside.withColumn(name, F.get(F.array(*[F.lit(v[part]) for v in intervals]), F.col("i")))
    else:
        ranges = local_rows(spark, [(i, *interval) for i, interval in enumerate(intervals)],
                            f"i int, ig {kind}, lo double, hi double, by_magnitude boolean")
        # At most groups x quantiles intervals: far below the size at which a broadcast would hurt.
        inside = clean.join(F.broadcast(ranges), F.col("g").eqNullSafe(F.col("ig"))
                            & F.col("x").between(F.col("lo"), F.col("hi")))
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    # Halves, so that the width of the widest interval does not overflow; the narrowest one may vanish by it.
    even = F.coalesce(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2), F.when(x == lo, 0.0).otherwise(1.0))
    graded = (_magnitude(x) - _magnitude(lo)) / (_magnitude(hi) - _magnitude(lo))
    share = F.when(F.col("by_magnitude"), graded).otherwise(even)
    bin_of = F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1))
    counted = (inside.select("i", "x", bin_of.alias("bin")).groupBy("i", "bin")
               .agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    upto = F.sum("k").over(Window.partitionBy("i").orderBy("bin"))      # at most BINS rows per interval
    ends = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("k"))
    hits = (ends.join(F.broadcast(places), "i")
            .where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("upto")))
            .select("i", "place", "before", "lo", "hi").collect())

    still_open: dict[tuple, list] = {}
    for h in hits:
        key = intervals[h["i"]]
        for rank, place in pending[key]:
            if place != h["place"]:
                continue
            if h["lo"] == h["hi"]:
                found[key[0], rank] = h["lo"]
            elif place == h["before"]:
                found[key[0], rank] = h["lo"]       # the first value of the bin is its smallest
            else:
                by_magnitude = not key[3] and _spans_magnitudes(h["lo"], h["hi"])
                still_open.setdefault((key[0], h["lo"], h["hi"], by_magnitude), []).append((rank, place - h["before"]))
    return still_open


def _spans_magnitudes(lo: float, hi: float) -> bool:
    small, large = sorted((abs(lo), abs(hi)))
    return lo * hi <= 0 or large / BINS > small


def _magnitude(x: Column) -> Column:
    """Grows with ``x`` as its exponent does: 0 at zero, 1 at the smallest positive double, negative below zero."""
    return F.signum(x) * (F.log2(F.greatest(F.abs(x), F.lit(5e-324))) + 1075)


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of one column; an empty list when it has no values."""
    from .transforms import number

    rows = group_quantiles(df.select(F.lit(0).alias("g"), number(column).alias("x")), probs, groups=1).collect()
    return [rows[0][f"q{i}"] for i in range(len(probs))] if rows else []


def box_statistics(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Box-plot figures, in total or per group.

    ``n, min, q1, median, q3, max``, the whiskers (the furthest values within 1.5 quartile distances of the box) and
    the number of outliers beyond them.
    """
    from .transforms import number

    source = df.select((present(df, by) if by else F.lit("all")).alias("g"), number(column).alias("x"))
    boxes = group_quantiles(source, (0.25, 0.5, 0.75), groups=None if by else 1).toDF("g", "n", "mean", "std", "min", "max", "q1", "median", "q3")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = boxes.select(F.col("g").alias("of"), (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    if by is None:
        # One row: its fences are constants, and nothing is joined.
        fence = fences.first()
        fenced = source.withColumns({"low": F.lit(fence and fence["low"]).cast("double"),
                                     "high": F.lit(fence and fence["high"]).cast("double")})
    else:
        # One row per group; broadcast only while the groups are as few as the narrowing allows.
        few = boxes.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
        fenced = source.join(F.broadcast(fences) if few else fences, F.col("g").eqNullSafe(F.col("of")))
    within = F.col("x").between(F.col("low"), F.col("high"))
    reached = (fenced.where("x is not null").groupBy(F.col("g").alias("of"))
               .agg(F.min(F.when(within, F.col("x"))).alias("whisker_low"),
                    F.max(F.when(within, F.col("x"))).alias("whisker_high"),
                    F.count_if(~within).alias("n_outliers")))
    result = (boxes.join(reached, F.col("g").eqNullSafe(F.col("of")), "left")
              .select("g", "n", "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high", "n_outliers"))
    return result.withColumnRenamed("g", by) if by else result.drop("g")
