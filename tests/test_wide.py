"""Many columns, many tags, missing patterns and changed cells, against plain computations."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabloom as tl
from tabloom.operators import correlation, sparse, tags
from tabloom.plans import changes


# ---- correlations ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [512, 70])
def test_correlations_of_many_columns(spark, monkeypatch, block):
    """As pair by pair, with missing cells, far from zero, over blocks, and in one scan per block."""
    monkeypatch.setattr(correlation, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 160)) @ rng.normal(size=(160, 160)) * rng.lognormal(0, 2, 160) + rng.choice([0, 1e9, -1e6], 160)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    x[:, 8] = np.nan
    names = [f"c{i}" for i in range(160)]
    read = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(4)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = {(r["x"], r["y"]): r["r"] for r in tl.correlations(read.mapInArrow(count, read.schema), names).collect()}
    assert len(got) == 160 * 160
    # A scan per block, besides the first rows.
    assert seen.value <= len(x) * (1 + -(-160 // block))
    for i, j in [*itertools.combinations(range(0, 160, 3), 2), (7, 1), (8, 1), (8, 8), (7, 7), (3, 3)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        r = got[f"c{i}", f"c{j}"]
        if both.sum() < 2 or np.ptp(x[both, i]) == 0 or np.ptp(x[both, j]) == 0:
            assert r is None
        else:
            assert abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-7 and r == got[f"c{j}", f"c{i}"]


def test_correlations_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {r["r"] for r in tl.correlations(df, ["a", "b"]).collect()} <= {None}


# ---- sparse indicators ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("rows", [100_000, 0])
def test_sparse_tags(spark, rows):
    """By a dictionary that travels, and by a join."""
    cells = ["b, a, b", None, "", "c", " a ,nan", "d,c,b,a"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i long, t string").withColumn("t_tags", F.lit(1))
    own = sparse.sparse_tags(df, "t", ",", broadcast_rows=rows)
    assert own.name == "t_tags_2" and own.data.columns == ["i", "t", "t_tags", "t_tags_2"]
    names = {r["code"]: r["value"] for r in own.dictionary.collect()}
    assert names == dict(enumerate("abcd"))
    assert [[names[c] for c in r[0]] for r in own.data.orderBy("i").select(own.name).collect()] == [
        ["a", "b"], [], [], ["c"], ["a"], ["a", "b", "c", "d"]]
    assert Counter(map(tuple, own.sums().collect())) == Counter(map(tuple, tl.tag_frequency(df, "t", ",").collect()))
    wide = own.with_indicators({"has_a": "a", "has_z": "z"}).orderBy("i").collect()
    assert [r["has_a"] for r in wide] == [1, 0, 0, 0, 1, 1] and {r["has_z"] for r in wide} == {0}
    assert sparse.sparse_tags(df.limit(0), "t", ",", broadcast_rows=rows).data.count() == 0


def test_sparse_onehot_of_any_type(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (None,), (10.0,)], "x double")
    own = sparse.sparse_onehot(df, "x")
    assert sorted(len(r[0]) for r in own.data.select(own.name).collect()) == [0, 0, 1, 1]
    assert {r["value"] for r in own.dictionary.collect()} == {"2.0", "10.0"}


def test_many_tags_are_engineered_and_written(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 1500},u{i % 1300},v") for i in range(6000)], "i long, t string")
    e = tl.engineer(df, tl.profile(df))
    assert e.columns == ["i", "t", "t_tags"]
    e.write.parquet(str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).agg(F.sum(F.size("t_tags"))).first()[0] == 18_000


# ---- pairs of tags --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("spots", [1 << 20, 3])
@pytest.mark.parametrize("few", [100_000, 0])
def test_frequent_pairs_are_exact(spark, monkeypatch, spots, few):
    monkeypatch.setattr(tags, "PAIR_SPOTS", spots)
    monkeypatch.setattr(tags, "BROADCAST_ROWS", few)
    rng = random.Random(7)
    rows = [",".join(f"t{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 9))) for _ in range(800)]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    every = Counter({(r["tag_a"], r["tag_b"]): r["n"] for r in tl.tag_cooccurrence(df, "t", ",").collect()})
    for least in (2, 15, 10_000):
        got = {(r["tag_a"], r["tag_b"]): r["n"] for r in tl.tag_cooccurrence(df, "t", ",", min_rows=least).collect()}
        assert got == {p: n for p, n in every.items() if n >= least}


# ---- missing cells --------------------------------------------------------------------------------------------------

def test_missing_patterns_over_many_columns(spark):
    rng = random.Random(8)
    names = [f"c{i}" for i in range(130)]  # three masks
    rows = [tuple(rng.choice([None, "  ", "x", "y"]) if i in (1, 64, 129) else "x" for i in range(130)) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    expected = Counter(tuple(n for n, v in zip(names, r) if v is None or not v.strip()) for r in rows)
    got = {tuple(r["columns"]): (r["n_missing"], r["n"]) for r in tl.missing_patterns(df).collect()}
    assert got == {k: (len(k), n) for k, n in expected.items()}
    # Closed sets by trying all.
    sets = {}
    for size in (2, 3):
        for own in itertools.combinations(["c1", "c64", "c129"], size):
            holding = [set(k) for k in expected.elements() if set(own) <= set(k)]
            if len(holding) >= 3 and set.intersection(*holding) == set(own):
                sets[own] = len(holding)
    assert {tuple(r["columns"]): r["n"] for r in tl.missing_together(df, 0.01).collect()} == sets
    assert tl.missing_together(df.limit(0)).count() == 0 and tl.missing_patterns(df.limit(0)).count() == 0


# ---- changes --------------------------------------------------------------------------------------------------------

def found(df):
    return Counter(map(tuple, df.collect()))


def test_cell_changes(spark):
    old = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "b", float("nan"), None), (3, "c", 3.0, "x"), (None, "n", 0.0, "x"),
                                 (5, "d", 5.0, "x"), (5, "d", 6.0, "x")], "k long, s string, f double, gone string")
    new = spark.createDataFrame([(5, "d", 6, "z"), (5, "d", 7, "z"), (1, "A", 1, "z"), (2, "b", None, None), (None, "n", -0, "z"),
                                 (4, "e", None, "z")], "k long, s string, f long, fresh string")
    got = found(tl.cell_changes(old.select("k", "s"), new.select("k", "s"), "k"))
    assert got == Counter([(1, "s", "changed", "a", "A"), (3, "s", "removed", "c", None), (4, "s", "added", None, "e")])
    got = found(tl.cell_changes(old.select("k", "gone"), new.select("k", "fresh").where("k = 1"), "k").where("k = 1"))
    assert got == Counter([(1, "gone", "changed", "x", None), (1, "fresh", "changed", None, "z")])
    twins = found(tl.cell_changes(old.select("k", F.col("f").try_cast("long")), new.select("k", "f"), "k").where("k = 5"))
    assert twins == Counter([(5, "f", "changed", "5", "6"), (5, "f", "changed", "6", "7")])
    assert tl.cell_changes(old, old.repartition(3), "k").count() == 0
    assert tl.cell_changes(old.limit(0), old.limit(0), ["k"]).count() == 0
    assert found(tl.cell_changes(old.select("k").where("k < 3"), new.select("k").where("k < 3"), "k")) == Counter()
    with pytest.raises(ValueError, match="must not be named"):
        tl.cell_changes(old.toDF("change", "s", "f", "g"), old, "change")


def test_work_follows_the_differences(spark):
    """Only buckets that hold a changed key are joined, and only columns that changed are named."""
    old = spark.range(100_000).selectExpr("id", "id % 7 AS a", "cast(id AS string) AS b")
    new = old.selectExpr("id", "if(id IN (5, 77777), 100, a) AS a", "b")
    buckets = changes.changed_buckets(old, new, ["id"], ["a", "b"]).collect()
    assert len(buckets) == 2 and {tuple(r["changed"]) for r in buckets} == {("a",)}
    assert found(tl.cell_changes(old, new, "id")) == Counter([(5, "a", "changed", "5", "100"), (77777, "a", "changed", "0", "100")])
