"""Collapse of cumulative conversation snapshots, and chat rendering. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_down

#: Turns of a conversation that one window numbers; longer conversations are put together from blocks.
BLOCK = 256


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, role, text, block, at, n``: the place of each turn in its conversation from 1, and their number.

    Turns are ordered by number, role and text, nulls first. Blocks of turn numbers are numbered apart and moved by the
    turns of the blocks before, so a long conversation is not one task's work.
    """
    turns = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = turns.withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    # The window's key as its first column keeps rows without an id together too.
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("turns"))
    running = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           F.coalesce(F.sum("turns").over(running), F.lit(0)).alias("start"),
                           F.sum("turns").over(whole).alias("n"))
    own = turns.withColumn("own", F.row_number().over(inside).cast("long"))
    same = own["conv_id"].eqNullSafe(starts["c"]) & (own["block"] == starts["b"])
    return own.join(starts, same).select("conv_id", "role", "text", "block", (F.col("own") + F.col("start")).alias("at"), "n")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``conv_id, at, n, first, second``: two 64-bit hashes of the turns up to each place.

    A prefix is the set of its turns with their places, so its hash is the exclusive or of theirs: it rolls on with
    every turn, and blocks can be put together.
    """
    def mark(seed: int):
        return F.xxhash64(F.lit(seed), "at", F.col("role").isNull(), F.coalesce("role", F.lit("")),
                          F.col("text").isNull(), F.coalesce("text", F.lit("")))

    marked = placed.select("conv_id", "block", "at", "n", mark(1).alias("a"), mark(2).alias("b"))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = marked.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    running = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("k"),
                           F.coalesce(F.bit_xor("a").over(running), F.lit(0)).alias("before_a"),
                           F.coalesce(F.bit_xor("b").over(running), F.lit(0)).alias("before_b"))
    own = marked.select("conv_id", "block", "at", "n", F.bit_xor("a").over(inside).alias("a"),
                        F.bit_xor("b").over(inside).alias("b"))
    same = own["conv_id"].eqNullSafe(starts["c"]) & (own["block"] == starts["k"])
    return own.join(starts, same).select("conv_id", "at", "n", F.col("a").bitwiseXOR(F.col("before_a")).alias("first"),
                                         F.col("b").bitwiseXOR(F.col("before_b")).alias("second"))


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """``conv_id, n, copies``: one conversation of each that is neither repeated nor the beginning of a longer one.

    Equal conversations meet in a map-side aggregate, of which the smallest id stays; equal prefixes too. So a first
    turn that a third of all conversations share is one row on either side of the anti join.
    """
    ends = hashes.filter("at = n").groupBy("n", "first", "second").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = hashes.filter("at < n").select("at", "first", "second").distinct()
    same = (ends["n"] == begun["at"]) & (ends["first"] == begun["first"]) & (ends["second"] == begun["second"])
    return ends.join(begun, same, "left_anti").select("conv_id", "n", "copies")


def render(placed: DataFrame) -> DataFrame:
    """``conv_id, chat``: the turns in order, each between ``<|im_start|>role`` and ``<|im_end|>`` lines.

    These marks inside a role or text are broken by a space, so a text cannot open or end a turn. A null role reads
    ``unknown``, a null text is empty. Blocks are rendered before the conversation, which is one value in the end.
    """
    def plain(name: str, instead: str):
        return F.replace(F.coalesce(name, F.lit(instead)), F.lit("<|im_"), F.lit("<| im_"))

    turn = F.concat(F.lit("<|im_start|>"), plain("role", "unknown"), F.lit("\n"), plain("text", ""), F.lit("<|im_end|>\n"))

    def joined(order: str, piece: str):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, piece))), lambda p: p[piece]), "")

    pieces = placed.select("conv_id", "block", "at", turn.alias("piece"))
    blocks = pieces.groupBy("conv_id", "block").agg(joined("at", "piece").alias("piece"))
    return blocks.groupBy("conv_id").agg(joined("block", "piece").alias("chat"))


def collapse_conversations(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation of ``turns`` (``conv_id, turn, role, text``): ``conv_id, n_turns, copies, chat``.

    A logged conversation that begins a longer one is left out, and of equal ones the smallest id stays; ``copies``
    counts the equal ones. Two turns are equal if role and text are, null only to null. Rows without an id are one
    conversation; repeated rows are repeated turns. Other columns are not read; an empty table gives an empty result.
    """
    placed = write_down(numbered_turns(turns), "chat-turns")
    kept = write_down(maximal_conversations(prefix_hashes(placed)), "chat-kept")
    wanted = placed.join(kept.select(F.col("conv_id").alias("kept_id")), F.col("conv_id").eqNullSafe(F.col("kept_id")),
                         "left_semi")
    chats = render(wanted).withColumnRenamed("conv_id", "chat_id")
    return kept.join(chats, F.col("conv_id").eqNullSafe(F.col("chat_id"))).select(
        "conv_id", F.col("n").alias("n_turns"), "copies", "chat")
