import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import whitening
from tabloom.llm.queries import QUERIES, table

from .conftest import SF


def plain(rows, most, weights="one"):
    """The same in numpy and whole numbers of any length: per usable row (x, deviation, whitened), and what holds for all."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in usable]
    copies = Counter(x for _, x in xs)
    fit = list(copies)
    w = [1 if weights == "one" else copies[x] for x in fit]
    n = sum(w)
    sums = [sum(k * x[d] for k, x in zip(w, fit)) for d in range(len(fit[0]))]
    centred = np.array([[(n * x[d] - sums[d]) / n for d in range(len(sums))] for x in fit])
    cov = (centred * np.array(w)[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    own = {x: (sum((n * a - s) ** 2 for a, s in zip(x, sums)), centred[k] @ vectors / np.sqrt(np.maximum(values, 1e-300)))
           for k, x in enumerate(fit)}
    return xs, own, n, values / np.trace(cov)


def compare(rows, got, most, weights="one"):
    xs, own, n, explained = plain(rows, most, weights)
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    assert Counter(r["vec_id"] for r in got) == Counter({i: most * k for i, k in Counter(i for i, _ in xs).items()})
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for i, x in xs:
        deviation, whitened = own[x]
        for r in by_row[i]:
            k = r["component"] - 1
            assert r["n"] == n and int(r["deviation"]) == deviation
            assert abs(r["explained"] - explained[k]) < 1e-9
            if abs(whitened[k]) > 1e-6:
                sign = signs.setdefault(k, math.copysign(1, r["whitened"] * whitened[k]))
                assert abs(sign * r["whitened"] - whitened[k]) < 1e-6


def test_query_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    got = QUERIES["op11_embedding_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    compare(rows, got.collect(), 16)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_awkward_vectors(spark, weights):
    rng = np.random.default_rng(8)
    base = [[float(c) for c in v] for v in rng.normal(size=(40, 5))]
    rows = list(enumerate(base))
    rows += [(100 + i, base[0]) for i in range(60)]  # a third of all rows is one vector
    rows += [(7, base[3]), (7, base[3])]  # rows that repeat
    near = [c + 1e-9 for c in base[5]]
    rows += [(200, near), (201, None), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [math.nan, 1.0, 1.0, 1.0, 1.0]),
             (204, [math.inf, 1.0, 1.0, 1.0, 1.0]), (205, [-1000.0, 1000.0, 0.0, 0.0, 5.5])]
    rows = [(i, v) for i, v in rows if i != 7] + [(300, base[7])]
    df = spark.createDataFrame([(i, v, "taken") for i, v in rows], "vec_id long, embedding array<double>, x string")
    compare(rows, whitening.whiten(df, 4, weights).collect(), 4, weights)


def test_rows_that_repeat_and_null_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(None if i % 5 == 0 else i // 2, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(30, 3)))]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df, 2).collect()
    assert Counter(r["vec_id"] for r in got) == Counter(i for i, _ in rows for _ in range(2))


def test_hot_and_other_vectors_meet(spark, monkeypatch):
    """The broadcast and the shuffled side together give every row once."""
    monkeypatch.setattr(whitening, "HOT_SHARE", 0.2)
    rng = np.random.default_rng(10)
    base = [[float(c) for c in v] for v in rng.normal(size=(20, 3))]
    rows = list(enumerate(base)) + [(50 + i, base[1]) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    compare([(i, [float(np.float32(c)) for c in v]) for i, v in rows], whitening.whiten(df, 3).collect(), 3)


def test_no_direction(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.collect() == [] and "whitened" in got.columns
    # A flat direction has no component.
    flat = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(9)], schema)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(ValueError, match="from 1 to 2 entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(i) * 1e12, -float(i % 7) * 1e11]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, own, _, _ = plain(rows, 2)
    xs = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows}
    for r in whitening.whiten(df).collect():
        assert int(r["deviation"]) == own[xs[r["vec_id"]]][0]


def test_with_whitened_keeps_all_rows_and_columns(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [0.0, 3.0], 2), (2, None, 3), (3, [5.0, 5.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened int")
    got = whitening.with_whitened(df)
    assert got.columns == ["vec_id", "embedding", "whitened", "whitened_1"]
    sizes = {r["whitened"]: r["whitened_1"] and len(r["whitened_1"]) for r in got.collect()}
    assert sizes == {1: 2, 2: 2, 3: None, 4: 2}
    assert got.select(F.col("whitened_1")[0]).count() == 4
