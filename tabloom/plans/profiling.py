"""Semantic profile of a table: what each column means, with the evidence.

Three passes, each reading only the columns it needs:

1. every column: rows, non-null rows and a sketch of the distinct count, merged in two levels so that no single task
   receives a sketch from every input split;
2. columns with few distinct values, also for their rows: one table of (column, value, count), from which every detector works on distinct
   values weighted by count; text columns with many distinct values: the same measures row by row, without moving a
   value through a shuffle; if exact distinct counts are wanted, the remaining columns' distinct values are counted;
3. tag columns and number-like text only: vocabulary and affixes.

What reaches the driver is one row per column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as k
from ..functions import cell, numeric_from_text, part_count, present, split_tags, strip, text_prefix, text_suffix
from ..functions.dates import DATE_HINTS, date_hint_index, parse_stripped_dates
from ..functions.ordinals import matching_scale
from ..functions.text import word_array
from ..session import local_rows

# Estimated distinct values up to which values are counted before they are judged: few, or few for the rows but no more
# than a task holds. A matter of plan.
GATE, GATE_SHARE, GATE_MOST = 1_000, 0.05, 100_000
LIST_LIMIT = 1_000      # most entries of a list kept inside the profile; profile_values() has all of them as rows
LIST_LENGTH = 200_000   # and its most characters
MOST_FREQUENT = 12      # entries of a longer list that the profile names
SAMPLE_LENGTH = 500     # characters kept of a sample value
# The words that decide about types; a column's set of them is one bit per word.
KNOWN_WORDS = sorted({"nan", *k.TRUE_WORDS, *k.FALSE_WORDS, *(w for scale in k.ORDINAL_SCALES for w in scale)})
_OTHER = "\0"           # stands for all other words
_BEYOND = "\1"          # stands for all values but zero and one
_SEEN = [*KNOWN_WORDS, _OTHER, _BEYOND]
_BITS = 62
_MASKS = range(-(-len(_SEEN) // _BITS))
SKETCH_SIZE = 12        # log2 of the sketch's registers: 1.6% error, 4 kB at most
FAN_IN = 256            # first-level groups of the sketch merge

PROFILE_SCHEMA = (
    "position int, name string, dtype string, semantic_type string, nullable boolean, n_unique long, n_total long, "
    "n_null long, sample_values array<string>, tag_separator string, tag_vocabulary array<string>, n_tags long, "
    "boolean_map map<string,boolean>, ordinal_order array<string>, numeric_prefix string, numeric_suffix string, "
    "categories array<string>, date_format_hint string, avg_length double, numeric_share double, date_share double, "
    "most_frequent array<string>")


def categorical_threshold(n_total: Column | int) -> Column:
    """Most distinct values a column of ``n_total`` rows may have to count as categorical."""
    n = F.lit(n_total) if isinstance(n_total, int) else n_total
    half = F.greatest(F.floor(n / 2), F.lit(10))
    return F.when(n <= 50, half).when(n <= 500, F.lit(30)).otherwise(F.least(F.lit(50), F.floor(n * 0.05)))


@dataclass
class _Column:
    """What the first pass knows of a column."""
    position: int
    name: str
    kind: str           # datetime, number, text or other
    dtype: str
    n_filled: int = 0
    estimate: int = 0
    sample: tuple = ()
    countable: bool = True      # whether values can be told apart; maps cannot

    @property
    def small(self) -> bool:
        return (self.estimate or 0) <= max(GATE, min(GATE_MOST, GATE_SHARE * self.n_filled))


def column_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "other"


def as_text(df: DataFrame, name: str) -> Column:
    return _text_of(present(df, name), df.schema[name].dataType)


def _text_of(value: Column, dtype: T.DataType) -> Column:
    text = value.cast("string")
    return F.initcap(text) if isinstance(dtype, T.BooleanType) else text


def long_form(df: DataFrame, names: list[str]) -> DataFrame:
    """``name, value``: the non-null cells of some columns as text, one row each; the name is the place in ``names``."""
    texts = df.select(*[as_text(df, n).alias(str(i)) for i, n in enumerate(names)])
    ids = [str(i) for i in range(len(names))]
    return texts.unpivot([], ids, "name", "value").where("value is not null")


def _typed_long_forms(df: DataFrame, names: list[str]) -> list[tuple[T.DataType, DataFrame]]:
    """``name, value`` per data type: cells are counted as they are, and only what is left is turned into text."""
    groups: dict[str, tuple[T.DataType, list[int]]] = {}
    for i, n in enumerate(names):
        dtype = df.schema[n].dataType
        if isinstance(dtype, T.IntegralType):
            dtype = T.LongType()
        groups.setdefault(dtype.simpleString(), (dtype, []))[1].append(i)
    forms = []
    for dtype, places in groups.values():
        cells = df.select(*[present(df, names[i]).cast(dtype).alias(str(i)) for i in places])
        forms.append((dtype, cells.unpivot([], [str(i) for i in places], "name", "value").where("value is not null")))
    return forms


def _value_table(df: DataFrame, names: list[str]) -> DataFrame:
    """``name, value, n``: distinct values as text with their counts."""
    return reduce(DataFrame.unionAll, [
        cells.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        .select("name", _text_of(F.col("value"), dtype).alias("value"), "n")
        for dtype, cells in _typed_long_forms(df, names)])


def _distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``name, n_distinct``; long text travels through the shuffle as a digest."""
    value = F.col("value")
    parts = []
    for dtype, cells in _typed_long_forms(df, names):
        if isinstance(dtype, T.StringType):
            cells = cells.withColumn("value", F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value))
        parts.append(cells.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_distinct")))
    return reduce(DataFrame.unionAll, parts)


def profile(df: DataFrame, distinct: str = "exact", sample_order: str | None = None,
            prose_guard: bool = False) -> DataFrame:
    """One row per column, in column order, with the fields of ``PROFILE_SCHEMA``.

    ``distinct="exact"`` counts the distinct values of every column, which shuffles the distinct values of columns with
    many of them. ``"approx"`` keeps the sketch's estimate for those (1.6% error) and counts only where the identifier
    rule is near its cut; no value is then shuffled. ``sample_order`` names a column whose order defines the sample
    values; without it any first rows are taken. ``prose_guard`` keeps sentences with commas from counting as tags: a
    separator with parts of more than 25 characters on average is no tag separator.

    Types depend on counts and on which of the known words occur, not on any list. ``categories`` and
    ``tag_vocabulary`` are listed up to 1,000 entries and 200,000 characters and null beyond; ``most_frequent`` then holds
    the 12 of them that most rows hold (of equals, the smallest), and ``profile_values`` gives all as rows. Sample values are
    cut after 500 characters.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be exact or approx")
    spark = df.sparkSession
    n_total, columns = _count_columns(df)
    _take_samples(df, columns, sample_order)
    measures = _measure(df, columns, n_total, distinct)
    base = local_rows(spark, [(c.position, c.name, c.dtype, c.kind, c.n_filled, c.estimate, list(c.sample), n_total)
                              for c in columns],
                      "position int, name string, dtype string, kind string, n_filled long, estimate long, "
                      "sample_values array<string>, n_total long")
    decided = _decide(base.join(measures, "position", "left"), prose_guard).collect()
    extras = _extras(df, decided)
    fields = T.StructType.fromDDL(PROFILE_SCHEMA).names
    rows = []
    for r in sorted(decided, key=lambda r: r["position"]):
        d = r.asDict()
        d.update(extras.get(r["name"], {}))
        rows.append(tuple(d.get(f) for f in fields))
    return local_rows(spark, rows, PROFILE_SCHEMA)


# ---- pass 1 -------------------------------------------------------------------------------------------------------

def _count_columns(df: DataFrame) -> tuple[int, list[_Column]]:
    columns = [_Column(i, f.name, column_kind(f.dataType), f.dataType.simpleString(),
                       countable="map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString())
               for i, f in enumerate(df.schema.fields)]
    if len({c.name for c in columns}) != len(columns):
        raise ValueError("column names repeat; clean the headers first")
    # Every cell is cut down to a hash in generated code; the sketches then see nothing but longs.
    hashes = []
    first = [F.count(F.lit(1)).alias("n")]
    second = [F.sum("n").alias("n")]
    for c in columns:
        i, value = c.position, present(df, c.name)
        mark = F.xxhash64(value) if c.countable else F.lit(1).cast("long")
        hashes.append(F.when(value.isNotNull(), mark).alias(f"h{i}"))
        first.append(F.count(f"h{i}").alias(f"f{i}"))
        second.append(F.sum(f"f{i}").alias(f"f{i}"))
        if c.countable:
            first.append(F.hll_sketch_agg(f"h{i}", F.lit(SKETCH_SIZE)).alias(f"d{i}"))
            second.append(F.hll_sketch_estimate(F.hll_union_agg(f"d{i}")).alias(f"d{i}"))
    row = (df.select(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("_fan"), *hashes)
           .groupBy("_fan").agg(*first).agg(*second).first())
    for c in columns:
        c.n_filled = row[f"f{c.position}"] or 0
        c.estimate = (row[f"d{c.position}"] or 0) if c.countable else None
    return row["n"] or 0, columns


def _take_samples(df: DataFrame, columns: list[_Column], order: str | None) -> None:
    """First non-null values of each column: one small read, and one more for all columns that it leaves short.

    The second read ranks the cells of these columns; Spark keeps the first ones of each in every task.
    """
    source = df.orderBy(order) if order else df
    head = source.select(*[F.left(as_text(df, c.name), F.lit(SAMPLE_LENGTH)).alias(str(c.position)) for c in columns]
                         ).limit(200).collect()
    short = []
    for c in columns:
        c.sample = tuple([r[c.position] for r in head if r[c.position] is not None][:k.SAMPLE_SIZE])
        if len(c.sample) < min(k.SAMPLE_SIZE, c.n_filled) and len(head) == 200:
            short.append(c)
    if not short:
        return
    place = cell(order) if order else F.monotonically_increasing_id()
    cells = df.select(place.alias("at"), *[F.left(as_text(df, c.name), F.lit(SAMPLE_LENGTH)).alias(str(c.position))
                                           for c in short])
    ids = [str(c.position) for c in short]
    first = Window.partitionBy("name").orderBy("at")
    more = (cells.unpivot(["at"], ids, "name", "value").where("value is not null")
            .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k.SAMPLE_SIZE).collect())
    for c in short:
        c.sample = tuple(r["value"] for r in sorted(more, key=lambda r: r["rank"]) if r["name"] == str(c.position))


# ---- pass 2 -------------------------------------------------------------------------------------------------------

def _text_measures(cells: DataFrame) -> DataFrame:
    """Detector sums per column over ``name, value, n``.

    Everything summed is a number: a smallest or first text would turn the aggregation into one that sorts its input.
    Of the known words a column keeps one bit each, and one bit for all others.
    """
    v, n = F.col("v"), F.col("n")
    # A letter that no number may hold rules the number test out at its first occurrence.
    wordy = v.rlike(r"[a-zA-Z&&[^eEinftyINFTYR]]")
    known = (F.length(v) <= max(map(len, KNOWN_WORDS))) & F.lower(v).isin(*KNOWN_WORDS)
    measures = [F.when(wordy, False).otherwise(numeric_from_text(v).isNotNull()).alias("is_number"),
                F.when(parse_stripped_dates(v).isNotNull(), date_hint_index(v)).alias("date_shape"),
                F.length(v).alias("length"),
                # The place of a known word; all others share the one after them.
                F.when(known, F.array_position(word_array(KNOWN_WORDS), F.lower(v)) - 1)
                .otherwise(len(KNOWN_WORDS)).cast("int").alias("place"),
                # As numbers, since a decimal may read 1.00; booleans were turned into words.
                (~F.coalesce(F.when(F.length(v) <= 40, v.try_cast("double")).isin(0.0, 1.0) | v.isin("True", "False"),
                             v.isin("True", "False"))).alias("beyond")]
    inner = []      # parts of the stripped text: fewer only for separators that begin or end with a blank
    for i, sep in enumerate(k.TAG_SEPARATORS):
        has = F.contains("value", F.lit(sep))
        measures.append(F.when(has, part_count(F.col("value"), sep)).otherwise(1).alias(f"parts{i}"))
        if sep != sep.strip():
            measures.append(F.when(has, part_count(v, sep)).otherwise(1).alias(f"inner{i}"))
        inner.append(f"inner{i}" if sep != sep.strip() else f"parts{i}")
    # The text is copied into a variable of its own: Spark passes an unpivoted one to functions under a name that does not
    # compile, and then interprets the whole stage.
    flags = (cells.select("name", "n", strip(F.col("value")).alias("v"), F.concat("value", F.lit("")).alias("value"))
             .select("name", "n", *measures))

    # Few states, so that the code of one aggregate stays small: shapes of dates are groups, the rest are plain sums.
    numbers = [n.alias("n_values"), F.when(F.col("is_number"), n).otherwise(0).alias("n_number"),
               (F.col("length") * n).alias("length"), F.lit(1).cast("long").alias("n_entries")]
    for i in range(len(k.TAG_SEPARATORS)):
        numbers += [F.when(F.col(f"parts{i}") > 1, n).otherwise(0).alias(f"hits{i}"), (F.col(f"parts{i}") * n).alias(f"parts{i}")]
        numbers += [(F.col(inner[i]) * n).alias(f"inner{i}")] if inner[i] != f"parts{i}" else []
    bits = []
    for m in _MASKS:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") - m * _BITS)
        inside = F.when(F.col("place").between(m * _BITS, (m + 1) * _BITS - 1), bit).otherwise(F.lit(0).cast("long"))
        if len(_SEEN) - 1 in range(m * _BITS, (m + 1) * _BITS):
            inside = inside.bitwiseOR(F.when(F.col("beyond"), F.lit(1 << (len(_SEEN) - 1 - m * _BITS))).otherwise(0))
        bits.append(inside.alias(f"words{m}"))
    cut = flags.select("name", "date_shape", *numbers, *bits)
    masks = [F.bit_or(f"words{m}").alias(f"words{m}") for m in _MASKS]
    summed = [c for c in cut.columns if c not in ("name", "date_shape") and not c.startswith("words")]
    shapes = cut.groupBy("name", "date_shape").agg(*[F.sum(c).alias(c) for c in summed], *masks)
    whole = shapes.groupBy("name").agg(
        *[F.sum(c).alias(c) for c in summed], *masks,
        *[F.sum(F.when(F.col("date_shape") == i, F.col("n_values")).otherwise(0)).alias(f"dates{i}")
          for i in range(len(DATE_HINTS))])
    return whole.withColumns({f"inner{i}": F.col(f"parts{i}") for i, c in enumerate(inner) if c == f"parts{i}"})


def _measure(df: DataFrame, columns: list[_Column], n_total: int, distinct: str) -> DataFrame:
    """Measures per column position; every branch is one scan of the columns it needs."""
    known = [c for c in columns if c.kind in ("number", "text") and c.n_filled > 0]
    small = [c for c in known if c.small]
    wide_text = [c for c in known if c.kind == "text" and not c.small]
    # Values of nested types are counted, not judged, and so never stand in the table of values.
    wide = [c for c in columns if c.countable and (not c.small or (c.kind == "other" and c.n_filled > 0))]
    # Dates are never judged by their values; their distinct count is only reported.
    small_dates = [c for c in columns if c.kind == "datetime" and c.small and c.n_filled > 0]

    def near_cut(c: _Column) -> bool:
        return abs(c.estimate / max(n_total, 1) - k.IDENTIFIER_SHARE) < 0.1

    counted = wide if distinct == "exact" else [c for c in wide if c.kind == "text" and near_cut(c)]

    def place(group: list[_Column]) -> Column:
        """Turn the running number of ``long_form`` into the column's position."""
        return F.get(F.array(*[F.lit(c.position) for c in group]), F.col("name").cast("int"))

    branches = []
    group = small + small_dates
    if group:
        values = _value_table(df, [c.name for c in group])
        branches.append(_text_measures(values).withColumn("position", place(group))
                        .withColumn("n_distinct", F.col("n_entries")))
    if wide_text:
        cells = long_form(df, [c.name for c in wide_text]).withColumn("n", F.lit(1).cast("long"))
        branches.append(_text_measures(cells).withColumn("position", place(wide_text)))
    if counted:
        branches.append(_distinct_counts(df, [c.name for c in counted]).withColumn("position", place(counted)))
    schema = ("n_values long, n_number long, length long, "
              + "".join(f"dates{i} long, " for i in range(len(DATE_HINTS)))
              + "".join(f"hits{i} long, parts{i} long, inner{i} long, " for i in range(len(k.TAG_SEPARATORS)))
              + "".join(f"words{m} long, " for m in _MASKS) + "position int, n_distinct long")
    rows: dict[int, dict] = {}
    if branches:
        # One job, so that the branches run side by side.
        together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
        for r in together.collect():
            known_of = rows.setdefault(r["position"], {})
            known_of.update({f: v for f, v in r.asDict().items() if v is not None})
    kind = T.StructType.fromDDL(schema)
    return local_rows(df.sparkSession, [tuple(r.get(f) for f in kind.names) for r in rows.values()], kind)


def _words() -> Column:
    """The known words a column holds, and those that stand for all others and for values besides zero and one."""
    bit = [F.call_function("shiftright", F.col(f"words{i // _BITS}"), F.lit(i % _BITS)).bitwiseAND(F.lit(1).cast("long")) == 1
           for i in range(len(_SEEN))]
    return F.array_compact(F.array(*[F.when(b, F.lit(w)) for b, w in zip(bit, _SEEN)]))


# ---- the rules ----------------------------------------------------------------------------------------------------

def _decide(m: DataFrame, prose_guard: bool = False) -> DataFrame:
    """Semantic type of each column from its measures; the first rule that holds wins."""
    n_values = F.col("n_filled")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), n_values), F.lit(0.0))
    m = m.withColumn("seen", F.when(F.col("words0").isNotNull(), _words())).withColumn(
        "words", F.array_remove("seen", _BEYOND))
    spoken = F.array_except("words", word_array(["nan", ""]))
    yes, no = F.array_intersect(spoken, word_array(k.TRUE_WORDS)), F.array_intersect(spoken, word_array(k.FALSE_WORDS))
    is_boolean = (F.size(spoken).between(1, k.MAX_BOOLEAN_WORDS) & (F.size(yes) > 0) & (F.size(no) > 0)
                  & (F.size(yes) + F.size(no) == F.size(spoken)))
    boolean_map = F.map_concat(F.map_from_arrays(yes, F.transform(yes, lambda _: F.lit(True))),
                               F.map_from_arrays(no, F.transform(no, lambda _: F.lit(False))))

    def separates(i: int, sep: str) -> Column:
        holds = (share(f"hits{i}") > k.TAG_HIT_SHARE) & (share(f"parts{i}") > k.TAG_MEAN_PARTS)
        if prose_guard:
            of_separators = (F.col(f"parts{i}") - n_values) * len(sep)
            part_length = F.try_divide(F.col("length") - of_separators, F.col(f"parts{i}"))
            holds = holds & (part_length <= k.PROSE_PART_LENGTH)
        return holds

    separator = F.coalesce(*[F.when(separates(i, sep), F.lit(i)) for i, sep in enumerate(k.TAG_SEPARATORS)])
    inner_mean = F.get(F.array(*[share(f"inner{i}") for i in range(len(k.TAG_SEPARATORS))]), F.col("sep_index"))
    zero_one = (F.col("n_unique") == 2) & ~F.array_contains("seen", _BEYOND)
    text, number = F.col("kind") == "text", F.col("kind") == "number"
    few = F.col("n_unique") <= categorical_threshold(F.col("n_total"))
    scattered = F.try_divide(F.col("n_unique"), F.col("n_total")) > k.IDENTIFIER_SHARE
    mean_length = share("length")

    hint_counts = [F.coalesce(F.col(f"dates{i}"), F.lit(0)) for i in range(len(DATE_HINTS))]
    # The most frequent shape; of equals, the one listed first.
    usual_hint = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("i"), F.lit(hint).alias("hint"))
                                       for i, (c, (_, hint)) in enumerate(zip(hint_counts, DATE_HINTS))]))["hint"]
    m = m.withColumn("n_date", sum(hint_counts[1:], hint_counts[0]))
    d = m.withColumns({
        "n_unique": F.coalesce("n_distinct", "estimate"),
        "nullable": F.col("n_filled") < F.col("n_total"),
        "n_null": F.col("n_total") - F.col("n_filled"),
        "avg_length": F.when(text, F.try_divide(F.col("length"), n_values)),
        "numeric_share": F.when(text, F.try_divide(F.col("n_number"), n_values)),
        "date_share": F.when(text, F.try_divide(F.col("n_date"), n_values)),
        "date_hint": usual_hint,
        "scale": F.when(text, matching_scale(F.col("words"))),
        "sep_index": F.when(text, separator),
    })
    d = d.withColumn("maybe_tags", F.col("sep_index").isNotNull() & (inner_mean > k.TAG_MEAN_PARTS_CONFIRM))
    semantic = (
        F.when(F.col("kind") == "other", "unknown")
        .when(F.col("kind") == "datetime", "datetime")
        .when(n_values == 0, "categorical")
        .when(number & zero_one, "boolean")
        .when(number & few, "categorical")
        .when(number, "numeric")
        .when(is_boolean, "boolean")
        .when(share("n_number") > k.NUMERIC_SHARE, "numeric_string")
        .when(share("n_date") > k.DATE_SHARE, "date_string")
        .when(F.col("maybe_tags"), "multi_value_tags")
        .when(F.col("scale").isNotNull(), "ordinal"))
    tail = (F.when(few, "categorical")
            .when(scattered, F.when(mean_length > k.IDENTIFIER_TEXT_LENGTH, "free_text").otherwise("identifier"))
            .when(mean_length > k.CATEGORY_TEXT_LENGTH, "free_text")
            .otherwise("categorical"))
    separator_text = F.get(word_array(k.TAG_SEPARATORS), F.col("sep_index"))
    kind = F.col("semantic_type")
    return (
        d.withColumns({"tail": tail, "semantic_type": semantic})
        .withColumn("semantic_type", F.coalesce("semantic_type", "tail"))
        .withColumns({
            "boolean_map": F.when((kind == "boolean") & number,
                                  F.create_map(F.lit("1"), F.lit(True), F.lit("0"), F.lit(False)))
            .when(kind == "boolean", boolean_map),
            "ordinal_order": F.when(kind == "ordinal", F.col("scale")),
            "tag_separator": F.when(kind == "multi_value_tags", separator_text),
            "date_format_hint": F.when(kind == "date_string", F.col("date_hint")),
            "categories": F.when(kind == "ordinal", F.col("scale"))
            .when((kind == "categorical") & (n_values == 0), F.array().cast("array<string>")),
        }))


# ---- pass 3 -------------------------------------------------------------------------------------------------------

def _extras(df: DataFrame, decided: list) -> dict[str, dict]:
    """Vocabulary of tag columns, categories and affixes of number-like text, read from those columns only.

    A column with a separator but a single tag is no tag column; its type falls back to the later rules.
    """
    tags = [r for r in decided if r["semantic_type"] == "multi_value_tags"]
    numbers = [r for r in decided if r["semantic_type"] == "numeric_string"]
    listed = [r for r in decided if r["n_filled"] and (
        r["semantic_type"] == "categorical" or (r["semantic_type"] == "multi_value_tags" and r["tail"] == "categorical"))]
    branches = []
    if tags:
        branches.append(_lists("tags", _tag_words(df, tags)))
    if listed:
        values = _value_table(df, [r["name"] for r in listed]).select("name", strip(F.col("value")).alias("entry"), "n")
        branches.append(_lists("categories", values.groupBy("name", "entry").agg(F.sum("n").alias("n"))))
    if numbers:
        branches.append(_top_affixes(df, numbers))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches).collect() if branches else []

    result: dict[str, dict] = {r["name"]: {"numeric_prefix": "", "numeric_suffix": ""} for r in numbers}
    n_tags: dict[str, int] = {}
    words: dict[str, dict] = {}
    categories: dict[str, dict] = {}
    for t in found:
        if t["side"] == "tags":
            name = tags[int(t["name"])]["name"]
            n_tags[name], words[name] = t["n"], {"tag_vocabulary": t["list"], "most_frequent": t["top"]}
        elif t["side"] == "categories":
            categories[listed[int(t["name"])]["name"]] = {"categories": t["list"], "most_frequent": t["top"]}
        else:
            r = numbers[int(t["name"])]
            if t["n"] > r["n_filled"] * k.AFFIX_SHARE:
                result[r["name"]][t["side"]] = t["affix"]
    for r in tags:
        name, n = r["name"], n_tags.get(r["name"], 0)
        if n >= 2:
            result[name] = {"n_tags": n, **words[name]}
        else:
            kind = "ordinal" if r["scale"] is not None else r["tail"]
            result[name] = {"semantic_type": kind, "tag_separator": None, "ordinal_order": r["scale"], "categories": r["scale"]}
            if kind == "categorical":
                result[name] |= categories.get(name, {})
    for r in listed:
        if r["semantic_type"] == "categorical":
            result[r["name"]] = categories.get(r["name"], {"categories": None})
    return result


def _lists(side: str, entries: DataFrame) -> DataFrame:
    """``side, name, n, list, top`` of the distinct ``name, entry, n``: how many entries there are, all of them where they
    are few, and the most frequent ones where they are not; of equals, the smallest. Of these Spark keeps the first in
    every task."""
    counts = entries.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("entry")).alias("length"))
    # As many rows as there are columns to list.
    few = counts.withColumn("few", (F.col("n") <= LIST_LIMIT) & (F.col("length") <= LIST_LENGTH)).select("name", "few")
    marked = entries.join(F.broadcast(few), "name")
    lists = marked.where("few").groupBy("name").agg(F.array_sort(F.collect_set("entry")).alias("list"))
    often = Window.partitionBy("name").orderBy(F.desc("n"), "entry")
    real = ~F.lower("entry").isin("", "nan") if side == "tags" else F.lit(True)
    top = (marked.where(~F.col("few") & real).withColumn("place", F.row_number().over(often))
           .where(F.col("place") <= MOST_FREQUENT).groupBy("name")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda e: e["entry"]).alias("top")))
    return (counts.join(lists, "name", "left").join(top, "name", "left")
            .select(F.lit(side).alias("side"), "name", "n", "list", "top"))


def _tag_words(df: DataFrame, tags: list) -> DataFrame:
    """``name, entry, n``: the distinct tags of each tag column and how many rows hold them."""
    pieces = F
    for i, r in enumerate(tags):
        pieces = pieces.when(F.col("name") == str(i), F.array_distinct(
            split_tags(strip(F.col("value")), r["tag_separator"], drop_nan=False)))
    return (long_form(df, [r["name"] for r in tags]).select("name", F.explode(pieces).alias("entry"))
            .groupBy("name", "entry").agg(F.count(F.lit(1)).alias("n")))


def _top_affixes(df: DataFrame, numbers: list) -> DataFrame:
    """``side, name, n, affix``: most frequent prefix and suffix; of equals, the smallest."""
    v = F.col("value")
    sides = F.array(F.struct(F.lit("numeric_prefix").alias("side"), text_prefix(v).alias("affix")),
                    F.struct(F.lit("numeric_suffix").alias("side"), text_suffix(v).alias("affix")))
    counts = (long_form(df, [r["name"] for r in numbers]).select("name", F.explode(sides).alias("a"))
              .select("name", "a.*").where("affix is not null")
              .groupBy("name", "side", "affix").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("name", "side").agg(F.min(F.struct((-F.col("n")).alias("n"), "affix")).alias("best"))
    return best.select("side", "name", (-F.col("best.n")).alias("n"), F.col("best.affix").alias("affix"))


def profile_values(df: DataFrame, profile: DataFrame) -> DataFrame:
    """``name, value, n``: every value of the boolean, categorical and ordinal columns and every tag of the tag columns of
    a profile, with the number of rows that hold it. All of them, however many; nothing is collected.
    """
    rows = [r for r in profile.orderBy("position").collect() if r["name"] in df.columns]
    plain = [r["name"] for r in rows if r["semantic_type"] in ("boolean", "categorical", "ordinal")]
    tags = [r for r in rows if r["semantic_type"] == "multi_value_tags"]
    parts = []
    for group, cells in ((plain, long_form(df, plain) if plain else None),
                         ([r["name"] for r in tags], _tag_cells(df, tags) if tags else None)):
        if cells is not None:
            name = F.get(F.array(*[F.lit(n) for n in group]), F.col("name").cast("int"))
            counted = cells.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
            parts.append(counted.select(name.alias("name"), "value", "n"))
    if not parts:
        return local_rows(df.sparkSession, [], "name string, value string, n long")
    return reduce(DataFrame.unionAll, parts)


def _tag_cells(df: DataFrame, tags: list) -> DataFrame:
    """``name, value``: the different tags of each cell of the tag columns."""
    pieces = F
    for i, r in enumerate(tags):
        pieces = pieces.when(F.col("name") == str(i), F.array_distinct(split_tags(F.col("value"), r["tag_separator"])))
    return long_form(df, [r["name"] for r in tags]).select("name", F.explode(pieces).alias("value"))
