"""DataFrame operators against pandas on small tables."""

import math
import random
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabloom as tl
from tabloom.operators import encode, order_statistics


def test_to_boolean_takes_numbers_and_booleans(column, values):
    assert values(tl.to_boolean(column([1.0, 0.0, 2.0, None, float("nan")], "double"), "v")) == [
        True, False, False, None, None]
    assert values(tl.to_boolean(column([1, 0], "int"), "v")) == [True, False]
    assert values(tl.to_boolean(column([True, None], "boolean"), "v")) == [True, None]


def test_bin_numeric(column, values):
    got = values(tl.bin_numeric(column([1.0, 2.0, 3.0, 4.0, 10.0, None], "double"), "v", 5, output="v"))
    assert [b and b.bin for b in got] == [1, 1, 2, 2, 5, None]
    assert round(got[0].lo, 3) == 0.991 and got[4].hi == 10.0
    assert [b.bin for b in values(tl.bin_numeric(column([3.0, 3.0], "double"), "v", 5, output="v"))] == [3, 3]
    assert values(tl.bin_numeric(column([None], "double"), "v", output="v")) == [None]


def test_bin_numeric_labels(column, values):
    cells = [0.0, 18.0, 19.0, 64.0, 65.0, 120.0, 121.0, None]
    got = values(tl.bin_numeric(column(cells, "double"), "v", [0, 18, 64, 120], ["young", "adult", "old"], "v"))
    expected = pd.cut(pd.Series(cells), [0, 18, 64, 120], labels=["young", "adult", "old"], include_lowest=True)
    assert got == [None if pd.isna(e) else e for e in expected]
    with pytest.raises(ValueError):
        tl.bin_numeric(column([1.0], "double"), "v", [0, 1, 2], ["a"])
    with pytest.raises(ValueError):
        tl.bin_numeric(column([1.0], "double"), "v", [2, 1])


def test_normalize(column, values):
    cells = [1.0, 2.0, 4.0, None, 8.0]
    s = pd.Series(cells)
    for method, expected in (("minmax", (s - s.min()) / (s.max() - s.min())), ("zscore", (s - s.mean()) / s.std())):
        got = values(tl.normalize(column(cells, "double"), "v", method, "v"))
        assert [None if x is None else round(x, 12) for x in got] == [None if pd.isna(x) else round(x, 12)
                                                                     for x in expected]
    assert values(tl.normalize(column([3.0, 3.0, None], "double"), "v", output="v")) == [0.0, 0.0, None]
    assert values(tl.normalize(column([3.0, 3.0, None], "double"), "v", "zscore", "v")) == [None, None, None]
    assert values(tl.normalize(column([3.0], "double"), "v", "zscore", "v")) == [None]
    with pytest.raises(ValueError):
        tl.normalize(column([1.0], "double"), "v", "rank")


def test_make_ordinal(column, values):
    order = ["muito insatisfeito", "insatisfeito", "neutro", "satisfeito", "muito satisfeito"]
    df = tl.make_ordinal(column([" Satisfeito", "x", None, "NEUTRO"]), "v", [o.title() for o in order])
    assert values(df, "v_rank") == [3, None, None, 2]
    assert values(df) == ["satisfeito", None, None, "neutro"]
    assert df.schema["v"].metadata["ordinal_order"] == order
    plain = tl.make_ordinal(column(["a", "b"]), "v")
    assert plain.columns == ["id", "v"]
    assert values(tl.make_ordinal(column(["High", "low", None]), "v"), "v_rank") == [1, 0, None]


def test_date_features(column):
    df = tl.extract_date_features(column(["2024-05-15 13:45", None, "x"]), "v", "d")
    rows = [tuple(r)[2:] for r in df.orderBy("id").collect()]
    assert df.columns[2:] == ["d_year", "d_month", "d_day", "d_weekday", "d_hour"]
    assert rows == [(2024, 5, 15, "Wednesday", 13), (None,) * 5, (None,) * 5]


# ---- encodings ------------------------------------------------------------------------------------------------------

def test_encode_small(column, values):
    df = column(["b", "a", None, "b"])
    assert values(tl.encode_label(df, "v"), "v_label") == [1, 0, -1, 1]
    assert values(tl.encode_frequency(df, "v"), "v_frequency") == [2 / 3, 1 / 3, None, 2 / 3]
    onehot = tl.encode_onehot(df, "v", "p")
    assert onehot.columns == ["id", "v", "p_a", "p_b"]
    assert values(onehot, "p_a") == [0, 1, 0, 0] and values(onehot, "p_b") == [1, 0, 0, 1]
    with pytest.raises(ValueError):
        tl.encode_categorical(df, "v", "hash")
    with pytest.raises(ValueError):
        tl.encode_onehot(df, "v", max_columns=1)
    with pytest.raises(ValueError):
        tl.encode_onehot(onehot, "v", "p")


def test_encode_with_hot_values_nulls_and_no_broadcast(spark):
    """A third of the rows hold one value, a third are null; the dictionary is not broadcast."""
    rng = random.Random(1)
    cells = ["hot"] * 1500 + [None] * 1500 + [f"v{rng.randint(0, 900):04d}" for _ in range(1500)]
    rng.shuffle(cells)
    df = spark.createDataFrame(list(enumerate(cells)), "id long, v string").repartition(6)
    s = pd.Series(cells)
    codes = s.astype("category").cat.codes.tolist()
    shares = s.map(s.value_counts(normalize=True)).tolist()
    label = tl.encode_label(df, "v", broadcast_rows=5)
    got = {r.id: r.v_label for r in label.collect()}
    assert [got[i] for i in range(len(cells))] == codes
    share = {r.id: r.v_frequency for r in tl.encode_frequency(df, "v", broadcast_rows=5).collect()}
    for i, e in enumerate(shares):
        assert share[i] is None if pd.isna(e) else abs(share[i] - e) < 1e-12
    plan = label._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and label.count() == len(cells)


def test_answered_and_null_rows_are_spread_over_the_shuffle(spark):
    """Without any broadcast of the rest, no partition of the large side gets the hot or the null rows."""
    cells = ["hot"] * 3000 + [None] * 3000 + [f"v{i}" for i in range(2000)] * 2
    df = spark.createDataFrame(list(enumerate(cells)), "id long, v string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = tl.encode_label(df, "v", broadcast_rows=5)
        assert "hashpartitioning(_spread" in out._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        codes = {r.v: r.v_label for r in out.select("v", "v_label").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == len(cells) and max(sizes) < 2 * len(cells) / len(sizes)
    assert codes[None] == -1 and sorted(codes.values()) == list(range(-1, 2001))


def test_dense_codes_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 3 % 1000).cast("string").alias("v"))
    codes = encode.with_dense_codes(encode.value_counts(df, "v")).select("_value", "_code").collect()
    assert [r._value for r in sorted(codes, key=lambda r: r._code)] == sorted(str(i) for i in range(1000))
    assert sorted(r._code for r in codes) == list(range(1000))


# ---- tags -----------------------------------------------------------------------------------------------------------

CELLS = ["plástico, rede", "rede", None, "metal,plástico , vidro", "", "nan", "a-b, a b"]


def test_explode_tags(column, values):
    df = tl.explode_tags(column(CELLS), "v", ",", "t")
    assert df.columns == ["id", "v", "t_a_b", "t_metal", "t_pl_stico", "t_rede", "t_vidro"]
    assert values(df, "t_pl_stico") == [1, 0, 0, 1, 0, 0, 0]
    assert values(df, "t_rede") == [1, 1, 0, 0, 0, 0, 0]
    # "a-b" and "a b" share a column, which is set when either is present.
    assert values(tl.explode_tags(column(["a-b", "a b", "c"]), "v", ",", "t"), "t_a_b") == [1, 1, 0]


def test_explode_tags_finds_the_separator(column):
    assert tl.explode_tags(column(["x;y", "x", "y;z"]), "v").columns == ["id", "v", "v_x", "v_y", "v_z"]
    assert tl.explode_tags(column(["x y", "y"]), "v").columns == ["id", "v", "v_x", "v_y"]
    with pytest.raises(ValueError):
        tl.explode_tags(column(["x y", "y"]), "v", max_columns=1)


def test_indicator_sums_equal_tag_frequencies(column):
    df = column(CELLS)
    wide = tl.explode_tags(df, "v", ",", "t").agg(*[F.sum(c).alias(c) for c in ("t_metal", "t_rede")]).first()
    long = {r.tag: r.n for r in tl.tag_frequency(df, "v", ",").collect()}
    assert (wide.t_metal, wide.t_rede) == (long["metal"], long["rede"])


def test_separator_order_and_limits(column):
    assert tl.detect_tag_separator(column(["a,b;c", "a;b,c"]), "v") == ","
    assert tl.detect_tag_separator(column(["a / b", "c"]), "v") == " / "
    assert tl.detect_tag_separator(column(["a // b", "c // d"]), "v") == " // "
    # A quarter of the values is not more than a quarter.
    assert tl.detect_tag_separator(column(["a,b,c,d,e", "x", "y", "z"]), "v") is None
    assert tl.detect_tag_separator(column([None, None]), "v") is None


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(2)
    cells = [", ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 5))) for _ in range(200)] + ["a, b"] * 100
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    expected = Counter()
    for c in cells:
        expected.update(combinations(sorted({t.strip() for t in c.split(",") if t.strip()}), 2))
    got = {(r.tag_a, r.tag_b): r.n for r in tl.tag_cooccurrence(df, "v", ",").collect()}
    assert got == dict(expected)


# ---- tables ---------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sales(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["n", "s", None]), rng.choice(["x", "y", "z"]), rng.choice([None, round(rng.gauss(10, 4), 2)]),
             round(rng.expovariate(0.1), 3)) for i in range(800)]
    return spark.createDataFrame(rows, "id long, g string, k string, a double, b double"), pd.DataFrame(
        rows, columns=["id", "g", "k", "a", "b"])


def test_shares_sum_to_one(sales):
    df, pdf = sales
    shares = tl.share_by_group(df, "g", "k").groupBy("group").agg(F.sum("share").alias("s")).collect()
    assert len(shares) == 3 and all(abs(r.s - 1) < 1e-12 for r in shares)
    whole = tl.value_distribution(df, "g").agg(F.sum("share"), F.sum("n")).first()
    assert abs(whole[0] - 1) < 1e-12 and whole[1] == pdf.g.notna().sum()


def test_histogram_counts_every_value(sales):
    df, pdf = sales
    rows = tl.histogram(df, "a", 9).orderBy("bin").collect()
    expected = pd.cut(pdf.a, 9, include_lowest=True).value_counts(sort=False).tolist()
    assert [r.n for r in rows] == expected
    assert tl.histogram(df.where("a is null"), "a", 9).count() == 0


def test_crosstab(sales):
    df, pdf = sales
    got = {r.k: (r.n, r.s) for r in tl.crosstab(df, "k", "g").collect()}
    expected = pd.crosstab(pdf.k, pdf.g)
    assert got == {k: tuple(expected.loc[k]) for k in expected.index}


def test_correlation_over_common_rows(sales):
    df, pdf = sales
    got = {(r.x, r.y): r.r for r in tl.correlation_matrix(df, ["a", "b", "id"]).collect()}
    expected = pdf[["a", "b", "id"]].corr()
    assert len(got) == 9
    assert all(abs(r - expected.loc[x, y]) < 1e-9 for (x, y), r in got.items())


def test_correlation_by_either_way(sales, monkeypatch):
    df, _ = sales
    whole = {(r.x, r.y): r.r for r in tl.correlation_matrix(df, ["a", "b", "id"]).collect()}
    monkeypatch.setattr("tabloom.operators.tables._PAIRS_OF_AN_AGGREGATE", 2)
    assert {(r.x, r.y): r.r for r in tl.correlation_matrix(df, ["a", "b", "id"]).collect()} == pytest.approx(whole, abs=1e-12)


def test_time_trend_fills_gaps(spark):
    df = spark.createDataFrame([("2024-01-15", 1.0), ("2024-01-20", 2.0), ("2024-04-01", 5.0), (None, 9.0)],
                               "d string, x double").withColumn("d", F.col("d").cast("timestamp_ntz"))
    rows = tl.time_trend(df, "d", "month", "x", fill=True).orderBy("period").collect()
    assert [(str(r.period)[:7], r.n, r.total, r["mean"]) for r in rows] == [
        ("2024-01", 2, 3.0, 1.5), ("2024-02", 0, 0.0, None), ("2024-03", 0, 0.0, None), ("2024-04", 1, 5.0, 5.0)]
    assert tl.time_trend(df, "d", "month").count() == 2
    with pytest.raises(ValueError):
        tl.time_trend(df, "d", "decade")


@pytest.mark.parametrize("grain", ["year", "quarter", "month", "week", "day", "hour"])
def test_periods_do_not_depend_on_the_time_zone(spark, grain):
    """In New York 02:30 of this day does not exist."""
    cells = ["2024-03-10 02:30:15", "2024-12-31 23:59:59", "2023-01-01 00:00:00"]
    df = spark.createDataFrame([(c,) for c in cells], "d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    freq = {"year": "Y", "quarter": "Q", "month": "M", "week": "W-SUN", "day": "D", "hour": "h"}[grain]
    expected = sorted({str(pd.Timestamp(c).to_period(freq).start_time) for c in cells})
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(r.p for r in tl.time_trend(df, "d", grain).select(F.col("period").cast("string").alias("p")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == expected


def test_scatter_sample(sales):
    df, pdf = sales
    first = {r.id for r in tl.scatter_sample(df, "a", "b", 50, ["id"]).collect()}
    assert len(first) == 50
    assert first == {r.id for r in tl.scatter_sample(df.repartition(7), "a", "b", 50, ["id"]).collect()}
    assert tl.scatter_sample(df, "a", "b", 10_000).count() == pdf.a.notna().sum()


def test_filter_in(sales):
    df, pdf = sales
    assert tl.filter_in(df, {"k": ["x", "y"], "g": []}).count() == pdf.k.isin(["x", "y"]).sum()


def test_ordinal_distribution(column):
    rows = tl.ordinal_distribution(column(["Low", "high", "high ", None]), "v", ["low", "medium", "high"]).collect()
    assert [(r.rank, r.level, r.n) for r in rows] == [(0, "low", 1), (1, "medium", 0), (2, "high", 2)]
    with pytest.raises(ValueError):
        tl.ordinal_distribution(column(["q", "w"]), "v")


# ---- quantiles ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("make", [
    lambda rng: [rng.gauss(0, 1) for _ in range(3000)],
    lambda rng: [rng.lognormvariate(0, 6) for _ in range(3000)],
    lambda rng: [7.0] * 2000 + [rng.random() for _ in range(500)],
    lambda rng: [float(rng.randint(0, 3)) for _ in range(999)],
    lambda rng: [1e-300, 1e300, -1e300, 5.0],
    lambda rng: [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)],
    lambda rng: [5e-324, 0.0, 1e-323, 1.5e-323],
    lambda rng: [42.0],
    lambda rng: [-0.0, 0.0, 1.0],
    lambda rng: [float("inf"), float("-inf"), 1.0, 2.0, 3.0],
])
def test_quantiles_are_exact(column, make):
    cells = make(random.Random(4))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = tl.quantiles(column(cells, "double"), "v", probs)
    ordered = sorted(cells)
    for p, q in zip(probs, got):
        low, high, weight = order_statistics._position(p, len(ordered))
        a, b = ordered[low], ordered[high]
        expected = a if weight == 0 or a == b else a + (b - a) * weight
        assert q == expected or (math.isnan(q) and math.isnan(expected))


def test_group_quantiles(sales, monkeypatch):
    df, pdf = sales
    expected = pdf.groupby("k").a.quantile([0.25, 0.5, 0.75]).unstack()
    for limit in (2000, 1, 2):      # all narrowed; all sorted; large ones narrowed
        monkeypatch.setattr(order_statistics, "MAX_GROUPS", limit)
        got = tl.group_quantiles(df, [0.25, 0.5, 0.75], "k", "a").collect()
        assert len(got) == 3
        for r in got:
            assert all(abs(r[f"q{i}"] - expected.loc[r.k].iloc[i]) < 1e-9 for i in range(3))
            assert r.n == pdf[pdf.k == r.k].a.notna().sum()


def test_quantiles_of_many_groups_with_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(order_statistics, "MAX_GROUPS", 5)
    rng = random.Random(11)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(600)] + [(rng.choice("abcdefghij"), float(rng.randint(0, 20)))
                                                             for _ in range(300)]
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    expected = pdf.groupby("g").x.quantile([0.25, 0.5]).unstack()
    got = tl.group_quantiles(spark.createDataFrame(rows, "g string, x double"), [0.25, 0.5]).collect()
    assert {r.g for r in got} == set(expected.index)
    assert all(abs(r.q0 - expected.loc[r.g, 0.25]) < 1e-9 and abs(r.q1 - expected.loc[r.g, 0.5]) < 1e-9 for r in got)
    assert {r.g: r.n for r in got} == pdf.g.value_counts().to_dict()


def test_box_statistics(sales):
    df, pdf = sales
    for r in tl.box_statistics(df, "b", "k").collect():
        b = pdf[pdf.k == r.k].b
        q1, q3 = b.quantile(0.25), b.quantile(0.75)
        inside = b[(b >= q1 - 1.5 * (q3 - q1)) & (b <= q3 + 1.5 * (q3 - q1))]
        assert abs(r["median"] - b.median()) < 1e-9 and r.n == len(b)
        assert (r.whisker_low, r.whisker_high, r.n_outliers) == (inside.min(), inside.max(), len(b) - len(inside))
    assert tl.box_statistics(df, "b").count() == 1
    assert tl.quantiles(df.where("b < 0"), "b", [0.5]) == []


# ---- cleaning -------------------------------------------------------------------------------------------------------

def test_clean_names():
    assert tl.clean_names(["Unit Price (BRL)", "", "Unnamed: 3", "_c4", "orderDate", "Idade", "idade", "Preço"]) == [
        "unit_price_brl", "column_2", "column_3", "column_4", "order_date", "idade", "idade_2", "preço"]


def test_clean_names_never_repeat():
    names = tl.clean_names(["a", "a", "a_2", "A", "a-2", "", "column_6"])
    assert len(set(names)) == len(names)


def test_junk_rows_and_empties(spark):
    df = spark.createDataFrame([("a", "1", None), ("Name", " value ", "OTHER"), (None, None, None), ("Section", None, " "),
                                ("b", "2", None)], "name string, value string, other string")
    assert [r.name for r in tl.drop_junk_rows(df).collect()] == ["a", "b"]
    assert tl.drop_empty_rows(df).count() == 4
    assert tl.drop_empty_columns(df.where("name in ('a', 'b')")).columns == ["name", "value"]
    two = spark.createDataFrame([("a", None), (None, None)], "x string, y string")
    assert tl.drop_junk_rows(two).count() == 1


def test_merge_rename_fill(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, None, None), ("b", "c", 3.0)], "x string, y string, n double")
    assert [r.xy for r in tl.merge_columns(df, ["x", "y"], "xy", "-").collect()] == ["a", None, "b-c"]
    assert tl.merge_columns(df, ["x", "y"], "x", "-", drop=True).columns == ["n", "x"]
    assert tl.rename_columns(df, {"x": "z"}).columns == ["z", "y", "n"]
    with pytest.raises(ValueError):
        tl.rename_columns(df, {"q": "z"})
    assert [r.n for r in tl.fill_missing(df, method="mean", columns=["n"]).collect()] == [1.0, 2.0, 3.0]
    assert [r.y for r in tl.fill_missing(df, {"y": "?"}).collect()] == ["?", "?", "c"]
    assert tl.drop_missing(df, ["x"]).count() == 2
    assert tl.filter_rows(df, "n > 1").count() == 1


def test_missing_is_null_or_nan(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, float("nan")), (3, None), (4, 1.0)], "id int, `a.b` double")

    def read(frame, name):
        return [r[name] for r in frame.orderBy("id").select(f"`{name}`").collect()]

    assert read(tl.encode_label(df, "a.b", "code"), "code") == [0, 1, -1, -1, 1]
    assert read(tl.encode_label(df, "a.b", "code", broadcast_rows=0), "code") == [0, 1, -1, -1, 1]
    assert read(tl.encode_frequency(df, "a.b", "f"), "f") == [1 / 3, 2 / 3, None, None, 2 / 3]
    assert tl.encode_onehot(df, "a.b", "v").columns == ["id", "a.b", "v_0.0", "v_1.0"]
    assert sorted((r.value, r.n) for r in tl.value_distribution(df, "a.b").collect()) == [(0.0, 1), (1.0, 2)]
    assert sorted((r.value, r.n) for r in tl.distributions(df, ["a.b"]).collect()) == [("0.0", 1), ("1.0", 2)]
    assert tl.scatter_sample(df, "id", "a.b").count() == 3
    assert tl.crosstab_long(df, "id", "a.b").count() == 3
    assert read(tl.fill_missing(df, method="mean", columns=["a.b"]), "a.b") == [0.0, 1.0, 2 / 3, 2 / 3, 1.0]
    empty = spark.createDataFrame([(1, float("nan")), (2, None)], "id int, x double")
    assert tl.drop_empty_columns(empty).columns == ["id"]


def test_names_that_look_the_same(spark, tmp_path):
    df = spark.createDataFrame([("High", "Rede,rede"), ("high", "x"), ("low", "rede")], "p string, _tags string")
    out = tl.encode_onehot(df, "p")
    assert out.columns[2:] == ["p_High", "p_high_2", "p_low"]
    out.write.parquet(str(tmp_path / "out"))
    tags = tl.explode_tags(df, "_tags", ",", "t")
    assert tags.columns == ["p", "_tags", "t_Rede", "t_x"]
    assert sorted((r["_tags"], r["t_Rede"], r["t_x"]) for r in tags.collect()) == [("Rede,rede", 1, 0), ("rede", 1, 0), ("x", 0, 1)]
    values = spark.createDataFrame([("b", 1), ("a", 2)], "_value string, _answer int")
    assert sorted(map(tuple, tl.encode_label(values, "_value", "code").collect())) == [("a", 2, 0), ("b", 1, 1)]


def test_pairs_of_a_long_set(spark):
    words = [f"w{i:03}" for i in range(150)]
    df = spark.createDataFrame([(",".join(words),), (",".join(words[:3]),), (",".join(words[:3]),)], "v string")
    pairs = {(r.tag_a, r.tag_b): r.n for r in tl.tag_cooccurrence(df, "v", ",").collect()}
    assert len(pairs) == 150 * 149 // 2 and all(a < b for a, b in pairs)
    assert pairs["w000", "w001"] == 3 and pairs["w000", "w149"] == 1


def test_filled_trend_of_every_grain(spark):
    df = spark.sql("SELECT timestamp_ntz'2023-11-30 22:10:00' AS t UNION ALL SELECT timestamp_ntz'2024-03-02 01:00:00'")
    expected = {"year": 2, "quarter": 2, "month": 5, "week": 14, "day": 94, "hour": 2212}
    for grain, n in expected.items():
        rows = tl.time_trend(df, "t", grain, fill=True).collect()
        assert len(rows) == n and sum(r.n for r in rows) == 2, grain
