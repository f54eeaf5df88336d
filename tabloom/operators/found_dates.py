"""Dates whose shapes, and the order of day and month in them, are found in the column itself.

Every text is cut into its clock, names of months and runs of digits; words that only fill (weekdays, "of", "de") go. What is
left is a layout such as number, number, year with a mark between its parts. There are a few layouts and marks, so one
aggregate over all rows counts per layout how many values each order of year, month and day can read. Values that could be
read either way take the order of the others of their layout, or of the column's other layouts.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx
from ..constants import DATE_FILLERS, MONTH_WORDS
from ..functions.text import normalise, word_array
from ..session import local_rows

LONGEST = 64        # no date is longer
ORDERS = ("mdy", "dmy", "ymd", "ydm")
# Parts of a layout: N one or two digits, Y four, M a month's name, C eight digits -> the orders that may be meant.
LAYOUTS = {
    "NNY": ("mdy", "dmy"), "YNN": ("ymd", "ydm"), "NNN": ("mdy", "dmy", "ymd"), "C": ("ymd", "mdy", "dmy"),
    "NMY": ("dmy",), "MNY": ("mdy",), "YMN": ("ymd",), "YNM": ("ydm",), "NMN": ("dmy", "ymd"), "MNN": ("mdy",),
}
MARKS = "/.- "
# The same with each digit as a 9 and blanks between the parts -> layout.
_MASKS = {mask: layout for layout in LAYOUTS for mask in map(" ".join, itertools.product(
    *[{"N": ("9", "99"), "Y": ("9999",), "M": ("M",), "C": ("99999999",)}[part] for part in layout]))}

_NAMES = sorted((word for words in MONTH_WORDS for word in words), key=lambda w: (-len(w), w))
# Asking for a letter first spares every digit the alternatives.
_MONTH = r"(?<!\p{L})(?=\p{L})(?:" + "|".join(_NAMES) + r")(?!\p{L})\.?"
_FILLER = r"(?<!\p{L})(?=[\p{L}º])(?:" + "|".join(sorted(DATE_FILLERS, key=lambda w: (-len(w), w))) + r")(?!\p{L})"
# A zone is dropped: the local clock time is kept.
_CLOCK = (r"(?<![\d:])(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?(?: ?([ap])\.?m\b\.?)?"
          r"(?: ?(?:z|utc|gmt|[+\-]\d{2}:?\d{2}))?(?![\d:\p{L}])")


def _spelled(text: Column) -> Column:
    """Eight digits that are followed by a clock of four or six get colons in it."""
    for clock, spelled in ((r"(\d{2})(\d{2})(\d{2})z?", "$2:$3:$4"), (r"(\d{2})(\d{2})", "$2:$3")):
        text = F.regexp_replace(text, rf"^(\d{{8}})[t ]?{clock}$", "$1 " + spelled)
    return text


def _taken_apart(df: DataFrame, text: str, held: str) -> DataFrame:
    """``df`` with a struct: the text's ``layout``, null where it cannot be a date, its ``mark``, the ``first`` and ``last``
    number, and the moment that each order reads, null where there is no such day or time."""
    low = _spelled(normalise(fx.cell(text)))
    staged = df.withColumn(held, F.when(F.length(fx.cell(text)) <= LONGEST, low))
    low = F.col(held)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, _CLOCK, " "), _MONTH, " M "), _FILLER, " ")
    staged = staged.withColumn(held, F.struct(
        rest.alias("rest"), F.trim(F.regexp_replace(rest, r"[\s/.,\-_()']+", " ")).alias("parts"),
        F.regexp_extract(low, _CLOCK, 0).alias("clock"),
        F.rtrim(F.regexp_extract(low, _MONTH, 0), F.lit(".")).alias("month")))
    rest, parts, clock, month = (F.col(held)[name] for name in ("rest", "parts", "clock", "month"))
    mask = F.array_position(word_array(list(_MASKS)), F.translate(parts, "012345678", "999999999")).cast("int") - 1
    mark = F.regexp_extract(rest, r"^[^\dM]*(?:\d+|M)([" + MARKS.replace("-", r"\-") + "])", 1)
    of_word = F.get(F.array(*[F.lit(str(i)) for i, words in enumerate(MONTH_WORDS, 1) for _ in words]),
                    F.array_position(word_array([w for words in MONTH_WORDS for w in words]), month).cast("int") - 1)
    staged = staged.withColumn(held, F.struct(
        F.get(word_array(list(_MASKS.values())), mask).alias("layout"), mark.alias("mark"),
        F.split(F.when(month == "", parts).otherwise(F.replace(parts, F.lit("M"), of_word)), " ").alias("parts"),
        F.regexp_replace(clock, r"^(\d{1,2})[:h](\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?).*$", " $1:$2").alias("clock"),
        F.regexp_extract(clock, "[ap]", 0).alias("half")))
    of = F.col(held)
    # Of eight digits four are the year's, which come first or last.
    digits = F.get(of["parts"], F.lit(0))
    front, back = [F.when(of["layout"] == "C", F.array(*[F.substring(digits, *cut) for cut in cuts]))
                   .when(of["layout"].isNotNull(), of["parts"])
                   for cuts in (((1, 4), (5, 2), (7, 2)), ((1, 2), (3, 2), (5, 4)))]
    staged = staged.withColumn(held, F.struct(
        of["layout"].alias("layout"), of["mark"].alias("mark"), _hours_of_day(of["clock"], of["half"]).alias("clock"),
        front.alias("front"), back.alias("back")))
    of = F.col(held)
    moments = []
    for order in ORDERS:
        year, month, day = (F.get(of["front" if order[0] == "y" else "back"], F.lit(order.index(field))) for field in "ymd")
        century = F.when(F.length(year) > 2, "").when(F.lpad(year, 2, "0") >= "69", "19").otherwise("20")
        year = F.when(year != "0000", F.concat(century, F.lpad(year, F.greatest(F.length(year), F.lit(2)), F.lit("0"))))
        moments.append(F.concat(year, F.lit("-"), month, F.lit("-"), day, of["clock"]).try_cast("timestamp_ntz").alias(order))
    return staged.withColumn(held, F.struct(
        of["layout"].alias("layout"), of["mark"].alias("mark"), F.get(of["front"], F.lit(0)).try_cast("int").alias("first"),
        F.get(of["front"], F.lit(2)).try_cast("int").alias("last"), *moments))


def _hours_of_day(clock: Column, half: Column) -> Column:
    """The clock without AM and PM; null for an hour that goes with neither."""
    hour = F.substring_index(F.ltrim(clock), ":", 1).try_cast("int")
    # 12 AM is hour 0 and 12 PM hour 12; with either, there is no hour 0 or 13.
    of_day = F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    plain = F.translate(clock, ",", ".")
    return F.when(half == "", plain).otherwise(
        F.concat(F.lit(" "), of_day.cast("string"), F.substr(plain, F.instr(plain, ":"))))


def _counts(df: DataFrame, columns: Sequence[str]) -> list[Row]:
    """One row per column, layout and mark: values, and how many of them each order reads. One scan of the columns."""
    texts = df.select(*[fx.cell(c).cast("string").alias(str(i)) for i, c in enumerate(columns)])
    cells = texts.unpivot([], [str(i) for i in range(len(columns))], "name", "text").where("trim(text) <> ''")
    measured = _taken_apart(cells, "text", "of").select(
        "name", "of.layout", "of.mark", "of.first", "of.last", *[F.col(f"of.{order}").isNotNull().alias(order) for order in ORDERS])

    def spread(number: str) -> Column:
        return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number) % 64)))

    return (measured.groupBy("name", "layout", F.when(F.col("layout").isNotNull(), F.col("mark")).alias("mark"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(order).alias(order) for order in ORDERS],
                 F.count_if(F.col("dmy") & ~F.col("mdy")).alias("only_dmy"),
                 F.count_if(F.col("mdy") & ~F.col("dmy")).alias("only_mdy"),
                 spread("first").alias("first"), spread("last").alias("last")).collect())


def _settled(rows: list[Row], day_first: bool) -> list[tuple[Row, list[str], str]]:
    """The orders of each layout of one column, the one meant first, and what settled it."""
    votes = sum(r["only_dmy"] - r["only_mdy"] for r in rows if r["layout"] is not None)
    day_leads = votes > 0 or (votes == 0 and day_first)
    out = []
    for r in rows:
        if r["layout"] is None:
            continue
        # Of two digits that may be the year or the day, days take more values.
        year_leads = r["layout"] == "C" or r["layout"] == "NNN" and r["last"] > r["first"] or r["layout"] == "YNN"
        favour = [*(["ymd", "ydm"] if year_leads else []), *(["dmy", "mdy"] if day_leads else ["mdy", "dmy"]), "ymd"]
        ranked = sorted(LAYOUTS[r["layout"]], key=lambda order: (-r[order], favour.index(order)))
        if len(ranked) == 1:
            why = "layout"
        elif r[ranked[0]] > r[ranked[1]]:
            why = "values"
        elif {*ranked[:2]} == {"dmy", "mdy"}:
            why = "other layouts" if votes else "default"
        else:
            why = "spread" if r["layout"] == "NNN" and r["first"] != r["last"] else "default"
        out.append((r, ranked, why))
    return out


def _pattern(layout: str, mark: str, order: str) -> str:
    if layout == "C":
        return "".join("%Y" if field == "y" else f"%{field}" for field in order)
    names = {("y", "Y"): "%Y", ("y", "N"): "%y", ("m", "M"): "%b", ("m", "N"): "%m", ("d", "N"): "%d"}
    return (mark or " ").join(names[field, part] for field, part in zip(order, layout))


def date_shapes(df: DataFrame, columns: str | Sequence[str] | None = None, day_first: bool = False) -> DataFrame:
    """The date shapes of text columns (all of them by default), found by one aggregate over all rows:

    ``name, layout, mark, pattern, n_values, n_read, n_next, settled_by``, one row per layout and the mark between its parts.
    ``pattern`` names the order that reads most values, ``n_read`` of them; the next best order reads ``n_next``. It is settled
    by the ``layout`` alone, the ``values``, the column's ``other layouts``, the ``spread`` of its numbers, or by the
    ``default``. A row without layout counts the values that are no dates. Zero-padding, clocks, weekdays and filling words
    make no shape of their own. Null and blank texts do not count; without any other there is no row.
    """
    names = _text_columns(df, columns)
    rows = _counts(df, names) if names else []
    out = []
    for i, name in enumerate(names):
        own = [r for r in rows if r["name"] == str(i)]
        for r, ranked, why in _settled(own, day_first):
            following = r[ranked[1]] if len(ranked) > 1 else 0
            out.append((name, r["layout"], r["mark"], _pattern(r["layout"], r["mark"], ranked[0]), r["n"], r[ranked[0]],
                        following, why))
        if other := sum(r["n"] for r in own if r["layout"] is None):
            out.append((name, None, None, None, other, 0, 0, None))
    return local_rows(df.sparkSession, out, "name string, layout string, mark string, pattern string, n_values long, "
                                            "n_read long, n_next long, settled_by string")


def parse_dates_by_column(df: DataFrame, columns: str | Sequence[str], day_first: bool = False) -> DataFrame:
    """Text columns to ``timestamp_ntz`` by the shapes that ``date_shapes`` finds in them, in place.

    A value that its layout's order cannot read is read by the next one that can; what is no date gives null. Beyond the
    shapes of ``parse_dates``: eight digits (with a clock of four or six more), year first or day first with any mark,
    names of months in English and Portuguese anywhere, weekdays and filling words, ``2024年5月15日``, ``14h30``.
    """
    names = _text_columns(df, columns)
    if not names:
        return df
    rows = _counts(df, names)
    result = df
    for i, name in enumerate(names):
        ranking = {r["layout"] + r["mark"]: ranked
                   for r, ranked, _ in _settled([r for r in rows if r["name"] == str(i)], day_first)}
        held = fx.free_name(result.columns, "_parts")
        taken = _taken_apart(result, name, held)
        of, moment = F.col(held), F.lit(None).cast("timestamp_ntz")
        if ranking:
            shape = F.array_position(word_array(list(ranking)), F.concat(of["layout"], of["mark"])).cast("int") - 1
            width = max(len(orders) for orders in ranking.values())
            read = F.array(*[of[order] for order in ORDERS])
            moment = F.coalesce(*[
                F.get(read, F.get(F.array(*[F.lit(ORDERS.index(orders[k]) if k < len(orders) else -1)
                                            for orders in ranking.values()]), shape)) for k in range(width)])
        result = taken.withColumn(name, moment).drop(held)
    return result


def _text_columns(df: DataFrame, columns: str | Sequence[str] | None) -> list[str]:
    if columns is None:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]
    return [columns] if isinstance(columns, str) else list(columns)
