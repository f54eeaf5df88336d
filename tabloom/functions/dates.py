"""Dates hidden in text, and the parts of a date.

Parsing rewrites every supported shape to ISO text with one regular expression, whose alternatives fill the same
replacement (an alternative that did not match adds nothing), and then uses ``try_cast`` to ``timestamp_ntz``. That avoids
the exception a per-pattern formatter throws for every miss, keeps the generated code small, and does not depend on the
session time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DATE_HINTS, WEEKDAYS
from .text import strip, word_array

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_WORD = (r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
               r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?")
_HALF = r"(?i)[ap]m$"
_LONGEST = 64       # no supported shape is longer
# Three parts, the cheapest thing to ask of a text before the full pattern; years and months alone are no dates.
_OUTLINE = r"^(?:\d{1,4}[ /.\-]\w+\.?,?[ /.\-]\d|[A-Za-z]{3,9}\.? \d{1,2},? \d)"


def _shape(day_first: bool) -> tuple[str, str]:
    """Pattern of all shapes, and the replacement that makes ISO text of them. ``5M`` stands for a month given by name."""
    month, two, sep = r"(0?[1-9]|1[0-2])", r"(\d{1,2})", r"[/.\-]"
    month_first = (rf"{month}{sep}{two}{sep}(\d{{4}})", "mdy")
    day_then_month = (rf"{two}{sep}{month}{sep}(\d{{4}})", "dmy")
    shapes = [
        (r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd"),
        (r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"),
        # The preferred reading comes first; the other one is for days above 12.
        *([day_then_month, month_first] if day_first else [month_first, day_then_month]),
        (r"(\d{1,2})M (\d{1,2}),? (\d{4})", "mdy"),
        (r"(\d{1,2})[ \-](\d{1,2})M,?[ \-](\d{4})", "dmy"),
    ]
    fields = {"y": "", "m": "", "d": ""}
    group = 0
    for _, order in shapes:
        for field in order:
            group += 1
            fields[field] += f"${group}"
    clock = r"(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?)"
    # A zone is dropped: the local clock time is kept.
    after = r"(?: ?[AaPp][Mm]| ?(?:Z|UTC|[+\-]\d{2}:?\d{2}))?"
    pattern = "^(?:" + "|".join(p for p, _ in shapes) + rf")(?:(?:T| {{1,3}}){clock}{after})?$"
    return pattern, f"{fields['y']}-{fields['m']}-{fields['d']} ${group + 1}"


def parse_dates(c: Column, day_first: bool = False) -> Column:
    """Text to ``timestamp_ntz``; each value is read on its own and unreadable ones give null.

    Supported: ``2024-05-15``, ``2024/05/15``, month and day in either order with ``/``, ``.`` or ``-`` and a four or
    two digit year (69 to 99 are of the 1900s), English month names, each with an optional time and AM/PM. An ambiguous
    day and month is read month first unless ``day_first``.
    """
    return parse_stripped_dates(strip(c.cast("string")), day_first)


def parse_stripped_dates(text: Column, day_first: bool = False) -> Column:
    pattern, iso = _shape(day_first)
    word = F.lower(F.substring(F.regexp_extract(text, _MONTH_WORD, 0), 1, 3))
    number = F.floor((F.instr(F.lit(_MONTHS), word) + 2) / 3).cast("string")
    plain = F.when(text.rlike(r"(?i)^(?:\d{1,2}[ \-])?[a-z]{3}"),
                   F.regexp_replace(text, F.lit(_MONTH_WORD), F.concat(number, F.lit("M")))).otherwise(text)
    for old, century in ((r"69|[7-9]\d", "19"), (r"\d{2}", "20")):
        plain = F.regexp_replace(plain, rf"^(\d{{1,2}}[/.\-]\d{{1,2}}[/.\-])({old})(?=[ T]|$)", f"$1{century}$2")
    # 12 AM is hour 0 and 12 PM hour 12: hour 0 and half a day later.
    plain = F.regexp_replace(plain, r"(?i)\b12(:\d{1,2}(?::\d{1,2})? ?[ap]m)$", "0$1")
    # Text of no supported shape is left as it is; past the outline below, the cast refuses it.
    moment = F.regexp_replace(plain, pattern, iso).try_cast("timestamp_ntz")
    half_day = F.when(text.rlike(_HALF), F.expr("INTERVAL '12' HOUR"))
    afternoon = F.when(F.lower(F.substring(text, -2, 1)) == "p", half_day)
    shifted = moment + F.coalesce(afternoon, F.expr("INTERVAL '0' HOUR"))
    return F.when((F.length(text) <= _LONGEST) & text.rlike(_OUTLINE), shifted)


# strftime directive -> (field, regular expression)
_DIRECTIVES = {
    "Y": ("year", r"(\d{4})"),
    "y": ("short_year", r"(\d{2})"),
    "m": ("month", r"(\d{1,2})"),
    "b": ("month_word", r"([A-Za-z]{3})"),
    "B": ("month_word", r"([A-Za-z]+)"),
    "d": ("day", r"(\d{1,2})"),
    "H": ("hour", r"(\d{1,2})"),
    "I": ("hour12", r"(\d{1,2})"),
    "p": ("half", r"([AaPp][Mm])"),
    "M": ("minute", r"(\d{1,2})"),
    "S": ("second", r"(\d{1,2})"),
    "f": ("fraction", r"(\d{1,6})"),
}


def parse_dates_as(c: Column, fmt: str) -> Column:
    """Text to ``timestamp_ntz`` by an explicit strftime format; other texts give null."""
    fields: list[str] = []
    pattern = ""
    for token in re.findall(r"%.|[^%]+", fmt):
        if token == "%%":
            pattern += "%"
        elif token.startswith("%"):
            if token[1:] not in _DIRECTIVES:
                raise ValueError(f"unsupported directive {token!r} in {fmt!r}")
            field, group = _DIRECTIVES[token[1:]]
            fields.append(field)
            pattern += group
        else:
            pattern += re.sub(r"([^\w\s])", r"\\\1", token)
    text = strip(c.cast("string"))
    shape = f"^{pattern}$"

    def part(field: str) -> Column:
        return F.regexp_extract(text, shape, fields.index(field) + 1)

    def number(field: str, default: int) -> Column:
        return part(field).try_cast("int") if field in fields else F.lit(default)

    if "year" in fields:
        year = number("year", 1900)
    elif "short_year" in fields:
        short = number("short_year", 0)
        year = short + F.when(short >= 69, F.lit(1900)).otherwise(F.lit(2000))
    else:
        year = F.lit(1900)
    if "month_word" in fields:
        position = F.instr(F.lit(_MONTHS), F.lower(F.substring(part("month_word"), 1, 3)))
        month = F.when(position % 3 == 1, F.floor((position + 2) / 3).cast("int"))
    else:
        month = number("month", 1)
    if "hour12" in fields:
        hour = number("hour12", 0) % 12
        if "half" in fields:
            hour = hour + F.when(F.lower(part("half")) == "pm", F.lit(12)).otherwise(F.lit(0))
    else:
        hour = number("hour", 0)
    second = number("second", 0).cast("decimal(16,6)")
    if "fraction" in fields:
        second = second + F.concat(F.lit("0."), part("fraction")).try_cast("decimal(16,6)")
    moment = F.try_make_timestamp_ntz(year, month, number("day", 1), hour, number("minute", 0), second)
    return F.when(text.rlike(shape), moment)


def date_hint_index(stripped: Column) -> Column:
    """Place in ``DATE_HINTS`` of a stripped date text."""
    found = F
    for i, (shape, _) in enumerate(DATE_HINTS[:-1]):
        found = found.when(stripped.rlike(shape), i)
    return found.otherwise(len(DATE_HINTS) - 1)


def date_pattern_hint(c: Column) -> Column:
    """strftime-like pattern of a date text, judged from how it starts; ``auto`` when none fits."""
    return F.when(c.isNotNull(), F.get(word_array([h for _, h in DATE_HINTS]), date_hint_index(strip(c))))


DATE_PARTS = ("year", "month", "day", "weekday", "hour")


def date_part(c: Column, part: str) -> Column:
    """One of year, month, day, weekday (English name) and hour of a date or timestamp."""
    if part == "weekday":
        return F.get(word_array(WEEKDAYS), F.dayofweek(c) - 1)
    if part not in DATE_PARTS:
        raise ValueError(f"unknown date part {part!r}; choose from {', '.join(DATE_PARTS)}")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[part](c)
