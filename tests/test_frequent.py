"""Most frequent values and exact quantiles: against plain counts, and how often the table is read."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabloom as tl
from tabloom.operators import frequent, order_statistics
from tabloom.plans.statistics import describe, summary_lines


def plain(rows, k):
    out = Counter()
    for name in {n for n, _ in rows}:
        counts = Counter(v for n, v in rows if n == name and v is not None)
        for rank, (v, n) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k], 1):
            out[name, v, n, rank] += 1
    return out


def columns(rng):
    zipf = [f"word{int(rng.paretovariate(0.8))}" for _ in range(4000)]
    long = ["same begin of a long text, " * 4 + str(i % 700) for i in range(2500)]
    rows = [("zipf", v) for v in zipf] + [("long", v) for v in long] + [("ids", f"id{i}") for i in range(2000)]
    rows += [("ids", "id7"), ("few", "a"), ("few", None), ("few", "b"), ("few", "b"), ("none", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tracked", [16_384, 300])
def test_most_frequent_values_are_exact(spark, monkeypatch, tracked):
    """With and without a proof by the sketch."""
    monkeypatch.setattr(frequent, "TRACKED", tracked)
    monkeypatch.setattr(frequent, "SKETCH_ERROR", 3.5 / (0.75 * tracked))
    rows = columns(random.Random(3))
    cells = spark.createDataFrame(rows, "name string, value string").repartition(5)
    assert Counter(tuple(r) for r in frequent.most_frequent(cells, 7).select("name", "value", "n", "rank").collect()) == plain(rows, 7)


def test_describe_names_the_top_value(spark):
    text = "x" * 70
    rows = [(text + "b", "u1", True), (text + "a", "u0", False), (text + "a", "u3", None), (text + "b", "u2", True), (None, None, None)]
    got = {r["name"]: r for r in describe(spark.createDataFrame(rows, "a string, b string, c boolean")).collect()}
    assert [(got[c]["count"], got[c]["unique"], got[c]["top"], got[c]["freq"]) for c in "abc"] == [
        (4, 2, text + "a", 2), (4, 4, "u0", 1), (3, 2, "True", 2)]


def test_categories_beyond_the_list(spark):
    """The profile names the most frequent ones, and its summary line shows ten of them."""
    values = [f"c{i % 1500}" for i in range(45_000)] + [f"often{i % 12:02}" for i in range(1_200)] + ["top"] * 300
    df = spark.createDataFrame([(v, f"{v}, t{i % 1300}, all") for i, v in enumerate(values)], "c string, t string")
    rows = {r["name"]: r for r in tl.profile(df).collect()}
    assert rows["c"]["semantic_type"] == "categorical" and rows["c"]["categories"] is None
    assert rows["c"]["most_frequent"] == ["top", *[f"often{i:02}" for i in range(11)]]
    assert rows["t"]["semantic_type"] == "multi_value_tags" and rows["t"]["tag_vocabulary"] is None
    assert rows["t"]["most_frequent"][:2] == ["all", "top"] and len(rows["t"]["most_frequent"]) == 12
    line = {r["name"]: r["line"] for r in summary_lines(tl.profile(df)).collect()}["c"]
    assert line.endswith("1513 categories, most frequent: ['top', " + ", ".join(f"'often{i:02}'" for i in range(9)) + "]…")


def counted(spark, df):
    """The table with a count of the rows that are read from it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_quantiles_take_two_scans(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=30_000), rng.lognormal(0, 3, 10_000), np.zeros(5_000)])
    df, seen = counted(spark, spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    assert np.allclose(tl.quantiles(df, "x", probs), np.quantile(x, probs), rtol=1e-12, atol=0)
    assert seen.value == 2 * len(x)


def test_quantiles_of_groups_too_large_to_keep(spark, monkeypatch):
    """Bins instead of values, and intervals the sketch missed: narrowing finds them."""
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=4_000), "b": rng.integers(0, 9, 3_000).astype(float), "c": np.exp(rng.normal(0, 20, 5_000)),
              "d": np.array([7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, x double")
    for keep, error, branches in ((10, 0.006, 64), (10**6, 0.0, 64), (10**6, 0.006, 1), (10, 0.0, 1)):
        monkeypatch.setattr(order_statistics, "KEEP", keep)
        monkeypatch.setattr(order_statistics, "ERROR", error)
        monkeypatch.setattr(order_statistics, "MAX_BRANCHES", branches)
        for r in tl.group_quantiles(df, [0.1, 0.5, 0.9]).collect():
            assert np.allclose([r["q0"], r["q1"], r["q2"]], np.quantile(groups[r["g"]], [0.1, 0.5, 0.9]), rtol=1e-12)
    assert df.agg(F.count("*")).first()[0] == len(rows)
