"""Document fingerprints by Order MinHash. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_rows
from .common import free_name, spread

#: Units per k-mer, buckets of a fingerprint, k-mers per bucket whose order is kept.
K, BUCKETS, TUPLE = 3, 64, 2
#: Layout of a number: bucket (6 bits), rank in it (37), position (20).
_POSITION, _ELEMENT = 20, 43
#: Rows of a range of ids, and the most ranges whose bounds are held as one constant.
_RANGE_ROWS, _RANGES = 1_000, 1 << 15


def _elements(units: Column) -> Column:
    """k-mers of units as numbers: hash above position. Shorter texts are one k-mer. Texts of over a million units get
    coarser positions, so that a position always fits; equal texts stay equal."""
    n = F.size(units)
    coarse = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int") - _POSITION)
    mask = F.lit((1 << _ELEMENT) - 1)

    def packed(value: Column, at: Column) -> Column:
        return F.call_function("shiftleft", value.bitwiseAND(mask), F.lit(_POSITION)).bitwiseOR(
            F.call_function("shiftright", at.cast("long"), coarse))

    many = F.transform(F.sequence(F.lit(0), n - K), lambda i: packed(
        F.xxhash64(*(F.get(units, i + j) for j in range(K))), i))
    return (F.when(n >= K, many).when(n > 0, F.array(packed(F.xxhash64(F.array_join(units, " ")), F.lit(0))))
            .otherwise(F.array().cast("array<bigint>")))


def _high(x: Column, bits: int) -> Column:
    return F.call_function("shiftright", x, F.lit(bits))


def _numbered(found: Column) -> Column:
    """Sorted k-mers become elements: a k-mer and its occurrence number, hashed, with its position kept.

    Occurrences of a k-mer stand together in text order. The number of those before is found by doubling steps back, as
    far as the k-mer is the same; only repeated k-mers take these steps.
    """
    steps = F.array(*(F.lit(1 << b) for b in range(_POSITION, -1, -1)))
    low = F.lit((1 << _POSITION) - 1)
    mask = F.lit((1 << _ELEMENT) - 1)

    def same(x: Column, at: Column) -> Column:
        return F.coalesce((at >= 0) & (_high(F.get(found, F.greatest(at, F.lit(0))), _POSITION) == _high(x, _POSITION)),
                          F.lit(False))

    def element(x: Column, i: Column) -> Column:
        back = F.aggregate(steps, F.lit(0), lambda d, step: F.when(same(x, i - d - step), d + step).otherwise(d))
        number = F.when(same(x, i - 1), back).otherwise(F.lit(0))
        mixed = F.xxhash64(_high(x, _POSITION), number).bitwiseAND(mask)
        return F.call_function("shiftleft", mixed, F.lit(_POSITION)).bitwiseOR(x.bitwiseAND(low))

    return F.transform(found, element)


def _smallest(elements: Column) -> Column:
    """Of sorted elements the first ``TUPLE`` of each bucket."""
    shift = _POSITION + _ELEMENT - 6
    return F.filter(elements, lambda x, i: (i < TUPLE) | (
        _high(F.get(elements, F.greatest(i - TUPLE, F.lit(0))), shift) != _high(x, shift)))


def _tuples(kept: Column) -> Column:
    """Per bucket its number above the hash of its elements in text order."""
    shift = _POSITION + _ELEMENT - 6
    low = F.lit((1 << _POSITION) - 1)

    def bucket(x: Column) -> Column:
        return _high(x, shift)

    def pair(x: Column, i: Column) -> Column:
        first = (i == 0) | (bucket(F.get(kept, F.greatest(i - 1, F.lit(0)))) != bucket(x))
        y = F.get(kept, i + 1)
        a, b = _high(x, _POSITION), _high(y, _POSITION)
        alone = F.coalesce(bucket(y) != bucket(x), F.lit(True))
        mixed = F.when(alone, F.hash(a)).when(x.bitwiseAND(low) <= y.bitwiseAND(low), F.hash(a, b)).otherwise(F.hash(b, a))
        value = F.call_function("shiftleft", bucket(x), F.lit(32)).bitwiseOR(
            mixed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.when(first, value)

    return F.filter(F.transform(kept, pair), lambda v: v.isNotNull())


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as sorted numbers: a bucket and the hash of its tuple in each.

    Units are runs of up to 12 characters between white space; a k-mer is three of them. k-mers get occurrence numbers,
    every k-mer falls into one of 64 buckets by its hash, the two smallest of a bucket are hashed in the order they have
    in the text. So a fingerprint feels which k-mers there are, how often, and in what order, as edit distance does.
    Nulls and texts without any unit have no buckets. Every step is an expression over the row: no shuffle.
    """
    step = free_name([*df.columns, name], "_step")
    out = df.withColumn(step, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S{1,12}"), F.lit(0)))
    out = out.withColumn(step, _elements(F.col(step)))
    out = out.withColumn(step, F.sort_array(step))
    out = out.withColumn(step, _numbered(F.col(step)))
    out = out.withColumn(step, F.sort_array(step))
    out = out.withColumn(step, _smallest(F.col(step)))
    return out.withColumn(name, _tuples(F.col(step))).drop(step)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the buckets that either fingerprint has; 1 if both have none."""
    buckets = F.size(F.array_union(F.transform(a, lambda x: _high(x, 32)), F.transform(b, lambda x: _high(x, 32))))
    return F.when(buckets == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / buckets)


def printed(fingerprint: Column) -> Column:
    """A fingerprint as text: ten hexadecimal digits per bucket."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def with_next(df: DataFrame, id_column: str, columns: dict[str, str], order: str,
              prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``df`` with, for each pair of ``columns``, the value of its first in the row with the next id; the last row's
    next is the first. Rows of the same id follow each other by ``order``; a null id comes first.

    Ids are cut into ranges of about equal numbers of rows by approximate quantiles, of which a bounded number is held.
    A range is one window partition, so ``df`` is shuffled once; the first row of each range is also dealt to the range
    before it, as the one that follows its last row. ``prepare`` adds columns row by row before the shuffle; it runs once
    for each row dealt, not for those looked through for the first rows.
    """
    spark = df.sparkSession
    part, guest = (free_name([*df.columns, *columns.values()], n) for n in ("_range", "_guest"))
    id_ = F.col(id_column)
    rows = df.count()
    ranges = min(_RANGES, spread(rows, _RANGE_ROWS))
    bounds = []
    if ranges > 1:
        points = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(df.agg(F.percentile_approx(id_column, points, 4 * ranges)).first()[0] or []))
    if bounds:
        held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        steps = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length(), -1, -1)))
        place = F.aggregate(steps, F.lit(0), lambda a, s: F.when(
            F.coalesce(F.get(held, a + s - 1) <= id_, F.lit(False)), a + s).otherwise(a))
    else:
        place = F.lit(0)
    dealt = df.withColumn(part, place)
    firsts = [tuple(r) for r in dealt.groupBy(part).agg(F.min(id_column), F.count_if(id_.isNull())).collect()]
    firsts = sorted((p, None if nulls else low) for p, low, nulls in firsts)
    if not firsts:
        none = prepare(df)
        return none.withColumns({new: F.lit(None).cast(none.schema[old].dataType) for old, new in columns.items()})
    before = [(p, low, firsts[k - 1][0]) for k, (p, low) in enumerate(firsts)]
    to, low = free_name(df.columns, "_to"), free_name(df.columns, "_low")
    known = F.broadcast(local_rows(spark, before, f"`{part}` int, `{low}` long, `{to}` int"))
    guests = dealt.join(known, (dealt[part] == known[part]) & dealt[id_column].eqNullSafe(known[low])) \
        .select(*(dealt[c] for c in df.columns), F.col(to).alias(part))
    # Of rows that share the lowest id of a range the first by the order is the guest.
    guests = guests.groupBy(part).agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*", part)
    both = prepare(dealt).withColumn(guest, F.lit(False)).unionByName(prepare(guests).withColumn(guest, F.lit(True)))
    window = Window.partitionBy(part).orderBy(guest, id_column, order)
    both = both.withColumns({new: F.lead(old).over(window) for old, new in columns.items()})
    return both.filter(~F.col(guest)).drop(guest, part)


def edited_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprints of its text and of its edited text, and how alike they are.

    The edited text has its last half replaced by the beginning of the next document's, by ascending id. Columns:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null counts as the
    empty text. A single document is its own next one; rows of the same id follow each other by their text. Equal texts
    have equal fingerprints; two texts without any word are alike. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("text"))
    found = with_next(read, "doc_id", {"text": "next_text", "own": "next"}, "text",
                      lambda rows: with_fingerprint(rows, "text", "own"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    found = found.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(
        F.left("text", F.char_length("text") - half), F.left("next_text", half))).drop("text", "next_text")
    found = with_fingerprint(found.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "other").drop("edited")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"),
        printed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"))
