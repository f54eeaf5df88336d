"""Column functions against the pandas behaviour they stand for, and the documented edge cases."""

import math
import random
import warnings
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import constants, functions as fx
from tabloom.functions.ordinals import matching_scale

warnings.simplefilter("ignore")


def test_whitespace_is_what_python_strips():
    every = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(constants.WHITESPACE) == every


def test_strip(column, values):
    cells = ["  a ", "\t b ", "　c d ", "", " \n ", None, "x"]
    got = values(column(cells).withColumn("v", fx.strip(F.col("v"))))
    assert got == [None if c is None else c.strip() for c in cells]


def test_boolean_from_text(column, values):
    cells = [" Sim ", "Não", "maybe", "", None, "YES", "x", "nan", "0", "T", "1.0"]
    got = values(column(cells).withColumn("v", fx.boolean_from_text(F.col("v"))))
    assert got == [True, False, False, None, None, True, True, None, False, True, False]


def test_boolean_from_text_given_words(column, values):
    got = values(column(["R", " r", "A", None]).withColumn("v", fx.boolean_from_text(F.col("v"), ["R"])))
    assert got == [True, True, False, None]


NUMBERS = ["$1,200", "45%", "R$ 6.096", "(5)", "1d", "", None, "1e3", "-1,234.5", "€ 3", "1.234,56", "abc", "+5", ".5",
           "5.", "1e", "--5", "12 345", "R$ 7", "inf", "-Infinity", "0x1A", "1_0", "True", "nan", "¥10", "1.2.3"]


def test_numeric_from_text_as_pandas_reads_it(column, values):
    got = values(column(NUMBERS).withColumn("v", fx.numeric_from_text(F.col("v"))))
    cleaned = pd.Series(NUMBERS, dtype=object).astype(str).str.replace(r"[€£¥₹$R\s,%]", "", regex=True)
    expected = pd.to_numeric(cleaned, errors="coerce")
    assert [None if x is None else x for x in got] == [None if math.isnan(x) else x for x in expected]


def test_numeric_from_text_decimal_comma(column, values):
    cells = ["1.234,56", "R$ 6.096", "45,5%", "7", None, "a"]
    got = values(column(cells).withColumn("v", fx.numeric_from_text(F.col("v"), ",")))
    assert got == [1234.56, 6096.0, 45.5, 7.0, None, None]
    with pytest.raises(ValueError):
        fx.numeric_from_text(F.lit("1"), ";")


def test_affixes(column):
    rows = (column(["R$ 5", " $-3", "45 %", "-2", "12", "+7kg", "abc"])
            .select("id", fx.text_prefix(F.col("v")).alias("p"), fx.text_suffix(F.col("v")).alias("s"))
            .orderBy("id").collect())
    assert [(r.p, r.s) for r in rows] == [("R$", None), ("$", None), (None, "%"), (None, None), (None, None),
                                          (None, "kg"), ("abc", "abc")]


DATES = ["07/08/2024", "15/05/2024", "7/8/24", "07.08.2024", "15.05.2024", "07-08-2024", "2024/01/05", "Jan 5, 2024",
         "5 January 2024", "5-Jan-2024", "07/08/2024 3:00 PM", "07/08/2024 15:30", "2024-07-08T03:05:06.123",
         "2024-01-02 12:05 AM", "2024-01-02 12:05 PM", "hello", "a, b", "1/2", "127/76", "7/8/80", "PAC-0001",
         "Sept 5 2024", "December 31, 2023 11:59 PM", "30/02/2024", "2024-02-30", "13/13/2024", "ORD-1000",
         "31 March 2024", "2024-1-5", "5 May, 2024", "Mayor 5 2024", "2024-12-03 15:00", None, ""]


def test_parse_dates_as_pandas_reads_them(column, values):
    got = values(column(DATES).withColumn("v", fx.parse_dates(F.col("v"))))
    for cell, moment in zip(DATES, got):
        expected = pd.to_datetime(pd.Series([cell]), format="mixed", errors="coerce").iloc[0]
        assert moment == (None if expected is pd.NaT else expected.to_pydatetime()), cell


def test_parse_dates_random_iso_and_slash(column, values):
    rng = random.Random(7)
    days = [datetime(rng.randint(1970, 2068), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23),
                     rng.randint(0, 59)) for _ in range(200)]
    iso = [d.strftime("%Y-%m-%d %H:%M") for d in days]
    assert values(column(iso).withColumn("v", fx.parse_dates(F.col("v")))) == days
    slash = [d.strftime("%d/%m/%Y %I:%M %p") for d in days]
    assert values(column(slash).withColumn("v", fx.parse_dates(F.col("v"), day_first=True))) == days


def test_parse_dates_does_not_depend_on_the_time_zone(spark, column, values):
    """02:30 of this day does not exist in New York."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = column(["2024-03-10 02:30"]).select(fx.parse_dates(F.col("v")).cast("string").alias("a"),
                                                  fx.parse_dates_as(F.col("v"), "%Y-%m-%d %H:%M").cast("string")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == ("2024-03-10 02:30:00", "2024-03-10 02:30:00")


@pytest.mark.parametrize("fmt, cell", [
    ("%d/%m/%Y", "07/08/2024"), ("%Y%m%d", "20240115"), ("%d %b %Y", "5 Jan 2024"), ("%B %d, %Y", "March 9, 2021"),
    ("%y-%m-%d", "71-02-03"), ("%y-%m-%d", "21-02-03"), ("%I:%M %p %d.%m.%Y", "12:30 AM 01.02.2023"),
    ("%Y-%m-%dT%H:%M:%S.%f", "2024-01-02T03:04:05.678"), ("%d/%m/%Y", "31/02/2024"), ("%d/%m/%Y", "2024-01-01"),
])
def test_parse_dates_by_format(column, fmt, cell):
    got = column([cell]).select(fx.parse_dates_as(F.col("v"), fmt)).first()[0]
    expected = pd.to_datetime(pd.Series([cell]), format=fmt, errors="coerce").iloc[0]
    assert got == (None if expected is pd.NaT else expected.to_pydatetime())


def test_unknown_directive():
    with pytest.raises(ValueError):
        fx.parse_dates_as(F.lit("x"), "%Q")


def test_date_hint(column, values):
    cells = ["2024-05-15 10:00", "7/8/2024", "07/08/24", "7.8.2024", "7-8-2024", "Jan 5 2024", None]
    got = values(column(cells).withColumn("v", fx.date_pattern_hint(F.col("v"))))
    assert got == ["%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y", "%d.%m.%Y", "%d-%m-%Y", "auto", None]


def test_split_tags(column, values):
    cells = ["plástico, rede", " a ,, b,", None, "nan, x", "", "a b\tc"]
    assert values(column(cells).withColumn("v", fx.split_tags(F.col("v"), ","))) == [
        ["plástico", "rede"], ["a", "b"], [], ["x"], [], ["a b\tc"]]
    assert values(column(["a b\tc", " d e "]).withColumn("v", fx.split_tags(F.col("v"), None))) == [
        ["a", "b", "c"], ["d", "e"]]
    assert values(column(["a|b", "c / d"]).withColumn("v", fx.split_tags(F.col("v"), "|"))) == [["a", "b"], ["c / d"]]


@pytest.mark.parametrize("sep", constants.TAG_SEPARATORS)
def test_part_count_is_the_length_of_the_split(column, values, sep):
    rng = random.Random(3)
    cells = ["".join(rng.choice(["a", " ", "/", ",", ";", "|", " / ", " // "]) for _ in range(rng.randint(0, 12)))
             for _ in range(200)]
    got = values(column(cells).withColumn("v", fx.part_count(F.col("v"), sep)))
    assert got == [len(c.split(sep)) for c in cells]


def test_tag_suffix():
    assert fx.tag_suffix("plástico") == "pl_stico"
    assert fx.tag_suffix(" a--b! ") == "a_b"


def test_matching_scale(spark):
    def match(words):
        df = spark.createDataFrame([(words,)], "w array<string>")
        return df.select(matching_scale(F.col("w"))).first()[0]

    assert match(["high", "low"]) == ["low", "high"]
    assert match(["alto", "baixo", "médio"]) == ["baixo", "médio", "alto"]
    assert match(["critical", "low"]) == ["critical", "low"]
    assert match(["low"]) is None
    assert match(["low", "blue"]) is None
    assert match([]) is None


def test_bin_index_and_edges(column, values):
    rng = random.Random(5)
    for bins in (1, 2, 5, 7, 16):
        cells = [round(rng.uniform(-50, 50), 2) for _ in range(300)]
        edges = fx.equal_width_edges(min(cells), max(cells), bins)
        got = values(column(cells, "double").withColumn("v", fx.bin_index(F.col("v"), edges)))
        expected = pd.cut(pd.Series(cells), bins, labels=False, include_lowest=True)
        assert got == [int(b) + 1 for b in expected]
