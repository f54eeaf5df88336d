"""Shards of equal numbers of rows by balanced label propagation. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_rows
from .common import free_name, named, remove_written, small, write_down
from .ranks import numbered, slice_bits


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart, the first shards take the remainder."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard_of(rank: Column, sizes: list[int]) -> Column:
    """The shard of a row by its number among rows that fill the shards one after another."""
    out, upto = F.lit(len(sizes) - 1), sum(sizes)
    for s in range(len(sizes) - 1, -1, -1):
        upto -= sizes[s]
        out = out if s == len(sizes) - 1 else F.when(rank < upto + sizes[s], s).otherwise(out)
    return out.cast("int")


def cut_edges(pieces: DataFrame) -> int:
    """Pairs of rows of one group that lie in different shards."""
    whole = pieces.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("together"))
    return whole.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) - F.col("together")) / 2), F.lit(0.0))).first()[0]


def admitted(asked: dict[tuple[int, int], int], load: Sequence[int], capacity: Sequence[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that ask to move from one shard to another may, so that no shard is over its capacity.

    All that ask at first; a shard that would be too full turns away the surplus, from the most asked way on, which may
    leave others too full, until none is. What leaves a full shard makes room, so full shards swap rows.
    """
    flow = dict(asked)
    after = list(load)
    for (here, to), n in flow.items():
        after[here] -= n
        after[to] += n
    full = [s for s, n in enumerate(after) if n > capacity[s]]
    while full:
        to = full.pop()
        for way in sorted((w for w in flow if w[1] == to), key=lambda w: (-flow[w], w)):
            less = min(flow[way], max(0, after[to] - capacity[to]))
            flow[way] -= less
            after[to] -= less
            after[way[0]] += less
            if less and after[way[0]] > capacity[way[0]]:
                full.append(way[0])
    return {way: n for way, n in flow.items() if n}


def propagate(pieces: DataFrame, capacity: list[int], rounds: int = 50,
              seen: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Move linked rows towards their neighbours: ``group, shard, n`` after balanced label propagation.

    All rows of a group link to each other, so the labels around a row are its group's rows per shard; rows of one group
    and shard are interchangeable, and their number is all that moves. In a round every piece asks to move to its group's
    largest piece among the shards that are open. Shards admit what keeps them within ``capacity`` (``admitted``), in the
    order of a hash; what is turned away stays. A shard that turned rows away is closed until no open one is left, so that
    a group larger than a shard goes on to the next one. The sum of the squared pieces grows with each move; it ends when no
    move is left with all shards open, after ``rounds`` rounds at the latest. ``seen`` is shown each round's pieces and moves.
    """
    shards = len(capacity)
    tie = F.xxhash64("group", "shard")
    open_, moved = set(range(shards)), False
    for _ in range(rounds):
        load = {r["shard"]: r["n"] for r in pieces.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        best = (pieces.filter(F.col("shard").isin(sorted(open_))).groupBy("group")
                .agg(F.max(F.struct(F.col("n"), tie.alias("tie"), F.col("shard"))).alias("best")))
        # Of two equal pieces the one in a closed shard moves, else the one with the lower hash.
        lower = (tie < F.col("best.tie")) | ~F.col("shard").isin(sorted(open_))
        asking = (pieces.join(best, "group").filter((F.col("n") < F.col("best.n")) | ((F.col("n") == F.col("best.n")) & lower))
                  .select("group", "shard", "n", F.col("best.shard").alias("to"), F.xxhash64("group").alias("mix")))
        asking = write_down(asking, "shard-asking")
        asked = {(r["shard"], r["to"]): r["n"]
                 for r in asking.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        flow = admitted(asked, [load.get(s, 0) for s in range(shards)], capacity)
        if flow:
            following = _moved(pieces, asking, flow)
            remove_written(pieces)
            pieces, moved = following, True
            if seen:
                seen(pieces, sum(flow.values()))
        remove_written(asking)
        open_ -= {way[1] for way, n in asked.items() if flow.get(way, 0) < n}
        if not open_ or not asked:
            if not moved or (not asked and len(open_) == shards):
                break
            open_, moved = set(range(shards)), False
    return pieces


def _moved(pieces: DataFrame, asking: DataFrame, flow: dict[tuple[int, int], int]) -> DataFrame:
    """``pieces`` after as many rows went each way as ``flow`` says, those that asked first by a hash of their group."""
    ways = local_rows(pieces.sparkSession, [(here, to, n) for (here, to), n in flow.items()], "shard int, to int, most long")
    queue = asking.join(F.broadcast(ways), ["shard", "to"])  # a row per pair of shards
    bits = slice_bits(asking.count())
    cut = queue.withColumn("slice", F.shiftrightunsigned("mix", 64 - bits).cast("int") if bits else F.lit(0))
    running = Window.partitionBy("shard", "to").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("shard", "to", "slice").agg(F.sum("n").alias("rows")).select(
        "shard", "to", "slice", F.coalesce(F.sum("rows").over(running), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "to", "slice").orderBy("mix", "group").rowsBetween(Window.unboundedPreceding, -1)
    queued = cut.join(starts, ["shard", "to", "slice"]).withColumn(
        "before", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    moves = queued.withColumn("moved", F.least(F.col("n"), F.col("most") - F.col("before"))).filter("moved > 0")
    changes = moves.select("group", F.explode(F.array(
        F.struct(F.col("shard").alias("shard"), (-F.col("moved")).alias("n")),
        F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")))).alias("c")).select("group", "c.shard", "c.n")
    return write_down(pieces.unionByName(changes).groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0"),
                      "shard-pieces")


def balanced_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text",
                    seen: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``rows``: the shards' numbers of rows are at most one apart. Rows start where a hash puts them; under the law label
    propagation then cuts as few links as it can between rows of equal text (see ``propagate``, which ``seen`` follows). Rows without such a link fill what room is left. A group larger than a shard
    is spread over as few shards as have room. ``slot`` numbers a shard's rows from 0 without gaps; ``grown_shard`` is
    null under this law. Null counts as the empty text, so null and empty texts form a group; size is the text's UTF-8
    bytes plus one. Ids may be null or repeat: every row has its own place. An empty table gives an empty result; other
    columns are not read.
    """
    text = F.coalesce(named(text_column), F.lit("")).cast("binary")
    rows = docs.select(named(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    rows = write_down(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    groups = rows.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    groups = write_down(groups, "shard-groups")
    linked = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    capacity = quotas(total, shards)
    marked = rows.select("row", "group").join(small(groups), "group", "left")
    marked = write_down(marked, "shard-marked")

    # The start knows nothing of the groups: linked rows are dealt by a hash of their own.
    dealt = numbered(marked.filter("n IS NOT NULL").select("row", "group"), [], F.col("row"), linked, "rank")
    dealt = dealt.select("group", shard_of(F.col("rank"), quotas(linked, shards)).alias("shard"))
    pieces = propagate(write_down(dealt.groupBy("group", "shard").agg(F.count("*").alias("n")), "shard-pieces"), capacity,
                       seen=seen)
    load = {r["shard"]: r["n"] for r in pieces.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    ends = (pieces.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("pieces")))
    ends = write_down(ends, "shard-ends")
    members = numbered(marked.filter("n IS NOT NULL").select("row", "group"), ["group"], F.col("row"), linked, "rank")
    # A group has at most one piece per shard: its rows fill them in turn.
    place = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("shard")),
                        lambda a, p: F.struct((a["upto"] + p["n"]).alias("upto"), F.when(
                            (a["shard"] < 0) & (F.col("rank") < a["upto"] + p["n"]), p["shard"])
                            .otherwise(a["shard"]).alias("shard")))
    grouped = members.join(small(ends), "group").select("row", place["shard"].alias("shard"))
    singles = numbered(marked.filter("n IS NULL").select("row"), [], F.col("row"), total - linked, "rank")
    filling = [capacity[s] - load.get(s, 0) for s in range(shards)]
    placed = write_down(grouped.unionByName(singles.select("row", shard_of(F.col("rank"), filling).alias("shard"))),
                        "shard-placed")
    slots = numbered(placed, ["shard"], F.col("row"), total, "slot")
    return rows.join(slots, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def add_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with its shard, for ``write.partitionBy``; all columns stay, whatever their names.

    Ids, one null among them, must tell the rows apart; an error names one that does not.
    """
    id_, shard = free_name(docs.columns, "_shard_id"), free_name(docs.columns, "shard")
    placed = balanced_shards(docs, shards, id_column, text_column).select(F.col("doc_id").alias(id_),
                                                                          F.col("shard").alias(shard))
    placed = write_down(placed, "shard-of-id")
    if again := placed.groupBy(id_).count().filter("count > 1").head():
        raise ValueError(f"{again['count']} rows have the {id_column} {again[id_]!r}")
    return docs.join(placed, named(id_column).eqNullSafe(F.col(id_))).drop(id_)
