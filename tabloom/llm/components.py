"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_written, write_down


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the two columns of ``edges``: the root is the component's smallest node.

    Alternating star contraction: every node passes the smallest node it sees to its larger neighbours, then to its
    smaller ones, until nothing changes; the number of rounds grows with the logarithm of the longest path. Each round
    is a map-side minimum per node and a join that Spark may split where one node has many neighbours; its edges are
    written to the shared folder, and only their count and checksum reach the driver.
    """
    a, b = edges.columns
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = write_down(now, "edges"), None
    while (mark := now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != before and mark[0]:
        before = mark
        # An edge goes from its larger node u to its smaller one v, so only nodes that are some edge's u see a smaller one.
        low = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        large = now.join(low, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        following = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        following = write_down(following, "edges")
        remove_written(now)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
