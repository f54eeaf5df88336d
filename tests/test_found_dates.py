"""Date shapes and orders found in columns."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabloom import date_shapes, engineer, parse_dates_by_column, profile

DAY = datetime(2024, 5, 15)


@pytest.mark.parametrize("text, moment", [
    ("20240515", DAY), ("20240515103000", DAY.replace(hour=10, minute=30)), ("20240515T1030", DAY.replace(hour=10, minute=30)),
    ("15 de maio de 2024", DAY), ("Wed, 15 May 24", DAY), ("2024年5月15日", DAY), ("May 15th, 2024 12:00 AM", DAY),
    ("15.05.2024 14h30", DAY.replace(hour=14, minute=30)), ("10:30 15/05/2024", DAY.replace(hour=10, minute=30)),
    ("2024-05-15T10:30:01.25+02:00", DAY.replace(hour=10, minute=30, second=1, microsecond=250000)),
    ("2024.15.05", DAY), ("15-MAI-2024", DAY), (" 15/5/24 11:05 p.m. ", DAY.replace(hour=23, minute=5)),
    ("13/13/2024", None), ("15/05/2024 13:00 PM", None), ("15/05/2024 25:00", None), ("31/02/2024", None), ("hello", None),
    ("555-1234", None), ("1,234,567", None), ("may 2024", None), ("", None), (" ", None), (None, None), ("0/5/2024", None),
    ("1/2/3/4", None), ("15/05/0000", None), ("x" * 100_000, None), ("1" * 30, None), ("$12.05.2024", None),
])
def test_shapes_of_single_values(spark, text, moment):
    df = spark.createDataFrame([(text,)], "v string")
    assert parse_dates_by_column(df, "v").first()["v"] == moment


def test_the_column_settles_day_and_month(spark):
    days = [datetime(2023, 1, 1) + timedelta(days=i) for i in range(400)]
    rows = [(i, d.strftime("%d/%m/%Y"), d.strftime("%m-%d-%y"), f"{d:%y.%m.%d}") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "id int, eu string, us string, short string").repartition(3)
    got = parse_dates_by_column(df, ["eu", "us", "short"]).orderBy("id").collect()
    assert [(r["eu"], r["us"], r["short"]) for r in got] == [(d, d, d) for d in days]
    why = {r["name"]: (r["pattern"], r["n_values"], r["n_read"], r["settled_by"]) for r in date_shapes(df).collect()}
    assert why == {"eu": ("%d/%m/%Y", 400, 400, "values"), "us": ("%m-%d-%y", 400, 400, "values"),
                   "short": ("%y.%m.%d", 400, 400, "spread")}


def test_other_layouts_settle_what_could_be_either(spark):
    df = spark.createDataFrame([("03/04/2024",), ("25.04.2024",), ("25.04.2024",)], "v string")
    shapes = {r["mark"]: (r["pattern"], r["settled_by"]) for r in date_shapes(df).collect()}
    assert shapes == {"/": ("%d/%m/%Y", "other layouts"), ".": ("%d.%m.%Y", "values")}
    alone = df.limit(1)
    assert [r["settled_by"] for r in date_shapes(alone).collect()] == ["default"]
    assert parse_dates_by_column(alone, "v").first()["v"] == datetime(2024, 3, 4)
    assert parse_dates_by_column(alone, "v", day_first=True).first()["v"] == datetime(2024, 4, 3)


def test_a_value_against_the_order_is_read_the_other_way(spark):
    df = spark.createDataFrame([(t,) for t in ("25/04/2024", "26/04/2024", "04/27/2024")], "v string")
    assert sorted(r["v"].day for r in parse_dates_by_column(df, "v").collect()) == [25, 26, 27]


def test_empty_tables_clashing_names_and_other_kinds(spark):
    df = spark.createDataFrame([], "`a.b` string, _parts string, n int")
    assert date_shapes(df).count() == 0
    assert parse_dates_by_column(df, ["a.b"]).dtypes[0] == ("a.b", "timestamp_ntz")
    full = spark.createDataFrame([("15/05/2024", "kept", 20240515)], df.schema)
    assert parse_dates_by_column(full, ["a.b", "n"]).first() == (DAY, "kept", DAY)
    assert date_shapes(full.select("n")).count() == 0 and parse_dates_by_column(full, []) is full


def test_engineer_by_the_columns_order(spark):
    df = spark.range(300).select(F.date_format(F.expr("date'2024-01-01' + CAST(id AS INT)"), "dd/MM/yyyy").alias("day"))
    got = engineer(df, profile(df), day_first=None).agg(F.countDistinct("day").alias("n"), F.max("day").alias("last")).first()
    assert got == (300, datetime(2024, 10, 26))
