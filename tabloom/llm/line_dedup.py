"""Line deduplication by a log-template tree. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, named, small, write_down

#: Leading words that choose a leaf, distinct texts in which a template recurs, least share of constant words.
DEPTH, TEXTS, SIMILAR = 3, 3, 0.5
#: Ascending shares of a leaf's lines that a word must hold at its place to be constant; one view of a line for each.
SHARES = (0.0, 0.001, 0.01, 0.1, 0.5)
_BLANKS = r"[ \t\x0B\f\r]+"


def _text(column: str) -> Column:
    return F.coalesce(named(column), F.lit(""))


def parsed_lines(docs: DataFrame, text_column: str, depth: int, similar: float = SIMILAR) -> DataFrame:
    """``raw, line, n, fixed, leaf, whole, words`` per line with any word; words are hashes, those with a digit zero.

    ``raw`` is a hash of the text the line is in, ``leaf`` of the number of its words and the first ``depth`` of them
    masked; ``fixed`` counts words that are not masked. ``whole`` is a hash of the masked words, or of the words as they
    are where less than ``similar`` of them would be left.
    """
    read = docs.select(F.xxhash64(_text(text_column)).alias("raw"),
                       F.posexplode(F.split(_text(text_column), "\n")).alias("line", "own"))
    own = F.filter(F.split("own", _BLANKS), lambda w: w != "")
    words = F.transform(own, lambda w: F.when(w.rlike("[0-9]"), F.lit(0).cast("long")).otherwise(F.xxhash64(w)))
    read = read.select("raw", "line", words.alias("words"), F.xxhash64(own).alias("verbatim"))
    read = read.withColumn("n", F.size("words")).filter("n > 0")
    read = read.withColumn("fixed", F.size(F.filter("words", lambda w: w != 0)))
    whole = F.when(F.col("fixed") >= similar * F.col("n"), F.xxhash64("words")).otherwise(F.col("verbatim"))
    return read.select("raw", "line", "n", "fixed", F.xxhash64("n", F.slice("words", 1, depth)).alias("leaf"),
                       whole.alias("whole"), "words")


def _recurring(rows: DataFrame, key: str, texts: int) -> DataFrame:
    """Values of ``key`` in at least ``texts`` distinct texts. Both counts combine map-side."""
    return rows.select(key, "raw").distinct().groupBy(key).agg(F.count("*").alias("t")).filter(F.col("t") >= texts).select(key)


def recurring_lines(docs: DataFrame, text_column: str = "text", depth: int = DEPTH, texts: int = TEXTS,
                    similar: float = SIMILAR) -> DataFrame:
    """``raw, line``: the lines of ``docs`` whose template recurs in at least ``texts`` distinct texts.

    The tree has a fixed depth: number of words, then the first ``depth`` words, words with a digit being variable from
    the start. Lines that recur as a whole are their own template; those of which less than ``similar`` would be constant
    recur if all their words do, digits included. The others share a leaf with lines of as many words
    and the same beginning; there a word is constant at its place if at least ``texts`` lines and a share of the leaf's
    lines have it there, otherwise the place is a variable field. A line is seen at each of ``SHARES``: values of a field
    that recur in a large leaf are constants at the low ones only, a template that is rare in its leaf keeps its words
    there. Lines with the same constants at the same places have the same template. Templates with less than ``similar``
    of their words constant say too little to drop anything. Copies of a text count once.
    """
    lines = write_down(parsed_lines(docs, text_column, depth, similar), "lines")
    telling = lines.filter(F.col("fixed") >= similar * F.col("n"))
    whole = write_down(_recurring(lines, "whole", texts), "lines-whole")
    exact = lines.select("raw", "line", "whole").join(small(whole), "whole", "left_semi").select("raw", "line")

    rest = lines.filter(F.col("n") > depth)
    shared = write_down(_recurring(telling.select("leaf", "raw", "whole").filter(F.col("n") > depth)
                                   .join(small(whole), "whole", "left_anti"), "leaf", texts), "lines-leaves")
    rest = rest.filter(F.col("fixed") >= similar * F.col("n")).join(small(whole), "whole", "left_anti") \
        .join(small(shared), "leaf", "left_semi").dropDuplicates(["raw", "line"])
    rest = write_down(rest.drop("whole"), "lines-rest")
    led = F.size(F.filter(F.slice("words", 1, depth), lambda w: w != 0))
    body = F.transform(F.slice("words", depth + 1, 1 << 30), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    spots = rest.select("raw", "line", "leaf", "n", led.alias("led"), F.explode(F.filter(body, lambda s: s["word"] != 0)).alias("s")) \
        .select("raw", "line", "leaf", "n", "led", "s.at", "s.word")
    counted = spots.groupBy("leaf", "at", "word").agg(F.count("*").alias("t")).filter(F.col("t") >= texts)
    sizes = write_down(rest.groupBy("leaf").agg(F.count("*").alias("lines")), "lines-sizes")
    reached = sum(((F.col("t") >= share * F.col("lines")).cast("int") for share in SHARES), F.lit(0))
    constant = counted.join(small(sizes), "leaf").select("leaf", "at", "word", reached.alias("reached"))
    constant = write_down(constant, "lines-constants")
    views = []
    for k in range(len(SHARES)):
        views += [F.count_if(F.col("reached") > k).alias(f"held{k}"),
                  F.bit_xor(F.when(F.col("reached") > k, F.xxhash64("at", "word"))).alias(f"mix{k}")]
    held = spots.join(small(constant), ["leaf", "at", "word"])
    # Lines without a constant have a template too: a row of each takes part that meets nothing.
    bare = rest.select("raw", "line", "leaf", "n", led.alias("led"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("word"),
                       F.lit(0).alias("reached"))
    found = held.unionByName(bare).groupBy("raw", "line", "leaf", "n", "led").agg(*views)
    telling_views = F.array(*(F.when(F.col("led") + F.col(f"held{k}") >= similar * F.col("n"),
                                     F.xxhash64("leaf", F.coalesce(f"mix{k}", F.lit(0))))
                              for k in range(len(SHARES))))
    found = found.select("raw", "line", F.explode(F.array_distinct(F.array_compact(telling_views))).alias("template"))
    found = write_down(found, "lines-templates")
    general = found.join(small(write_down(_recurring(found, "template", texts), "lines-general")), "template", "left_semi")
    return exact.unionByName(general.select("raw", "line")).distinct()


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH,
                texts: int = TEXTS, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_dropped, text`` without the lines of recurring templates.

    Null counts as the empty text, which is one empty line; lines without a word stay. Rows that repeat are cleaned
    alike; other columns are not read. An empty table gives an empty result.
    """
    gone = recurring_lines(docs, text_column, depth, texts, similar)
    # A text's own lines only: no larger than the text.
    gone = write_down(gone.groupBy("raw").agg(F.collect_list("line").alias("gone")), "lines-gone")
    read = docs.select(named(id_column).alias("doc_id"), _text(text_column).alias("text"))
    key = free_name(read.columns, "raw")
    found = read.withColumn(key, F.xxhash64("text")).join(small(gone), key, "left")
    gone_, lines = F.coalesce("gone", F.array().cast("array<int>")), F.split("text", "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains(gone_, i))
    return found.select("doc_id", F.size(lines).alias("n_lines"), F.size(gone_).alias("n_dropped"),
                        F.when(F.size(gone_) == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))
