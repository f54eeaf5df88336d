"""Most frequent values, exact, without moving whole texts.

A sketch of heavy hitters per column (Misra-Gries, merged map-side) names candidates and bounds how often any other value
can occur. One filtered scan counts the candidates; where the last one wanted occurs more often than the bound, the answer
is proven. Columns without a proof, such as identifiers, are counted by digest: values of up to 64 characters as they are,
longer ones as a digest and their first 64 characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze

CANDIDATES, TRACKED = 256, 16_384
#: Heaviest error of a sketch as a share of the rows: see the bounds of the sketch's library.
SKETCH_ERROR = 3.5 / (0.75 * TRACKED)
PREFIX = 64
_BROADCAST_ROWS = 100_000


def counts_by_digest(cells: DataFrame) -> DataFrame:
    """``name, key, prefix, n`` of ``name, value``: the count of each distinct value, which does not travel if it is long."""
    value = F.col("value")
    key = F.when(F.length(value) > PREFIX, F.sha2(value, 256)).otherwise(value)
    return cells.select("name", key.alias("key"), F.left(value, F.lit(PREFIX)).alias("prefix")).groupBy(
        "name", "key", "prefix").agg(F.count(F.lit(1)).alias("n"))


def top_of_counts(cells: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``name, value, n, rank`` of the ``k`` most frequent values by their ``counts_by_digest``; of equals, the smallest.

    Spark keeps the first ones of a column in every task. Only values longer than the prefix are read again, those that
    share it with one of the last rank included.
    """
    best = Window.partitionBy("name").orderBy(F.desc("n"), "prefix")
    chosen = freeze(counts.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= k).drop("rank"))
    short = F.length("prefix") < PREFIX
    values = chosen.where(short).select("name", F.col("prefix").alias("value"), "n")
    long = chosen.where(~short).select("name", "key", "n")
    n_long = long.count()
    if n_long:
        value = F.col("value")
        key = F.when(F.length(value) > PREFIX, F.sha2(value, 256)).otherwise(value)
        found = cells.where(F.length(value) >= PREFIX).withColumn("key", key).join(
            F.broadcast(long) if n_long <= _BROADCAST_ROWS else long, ["name", "key"])
        values = values.unionByName(found.select("name", "value", "n").distinct())
    order = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    return values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def most_frequent(cells: DataFrame, k: int) -> DataFrame:
    """``name, value, n, rank``: the ``k`` most frequent values of each ``name`` of ``name, value``, exact; of equals, the
    smallest. There are few names, such as the columns of a table."""
    marked = cells.where("value IS NOT NULL").withColumn("mark", F.xxhash64("value"))
    wanted = max(CANDIDATES, 2 * k)
    sketched = marked.groupBy("name").agg(
        F.expr(f"approx_top_k(mark, {wanted}, {max(TRACKED, wanted)})").alias("top"), F.count(F.lit(1)).alias("n"))
    heavy = sketched.select("name", "n", F.explode_outer("top").alias("t")).select("name", "n", "t.item", "t.count").collect()
    bounds: dict = {}
    for r in heavy:
        n_items, least, total = bounds.get(r["name"], (0, float("inf"), r["n"]))
        bounds[r["name"]] = n_items + (r["item"] is not None), min(least, r["count"] or 0), total
    marks = {(r["name"], r["item"]) for r in heavy if r["item"] is not None}
    order = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    parts, open_ = [], list(bounds)
    if marks:
        kind = cells.schema["name"].dataType.simpleString()
        candidates = cells.sparkSession.createDataFrame(list(marks), f"name {kind}, mark long")
        counted = marked.join(F.broadcast(candidates), ["name", "mark"]).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        top = freeze(counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        least = {r["name"]: (r["rows"], r["n"]) for r in top.groupBy("name").agg(F.count("*").alias("rows"), F.min("n").alias("n")).collect()}
        proven = []
        for name, (n_items, smallest, total) in bounds.items():
            # What the sketch left out occurs at most as often as the least it lists, or as its error allows.
            bound = max(2 * SKETCH_ERROR * total, smallest if n_items >= wanted else 0)
            rows, n = least.get(name, (0, 0))
            if rows == k and n > bound:
                proven.append(name)
        open_ = [name for name in bounds if name not in proven]
        if proven:
            parts.append(top.where(F.col("name").isin(proven)))
    if open_ or not parts:
        rest = cells.where(F.col("value").isNotNull() & F.col("name").isin(open_))
        parts.append(top_of_counts(rest, counts_by_digest(rest), k))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
