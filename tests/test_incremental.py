"""Profiles merged from parts equal the profile of the whole."""

import random

import pytest

import tabloom as tl
from tabloom.plans.incremental import ProfileState, Rescan

SF = "/root/testdata/sf0.001"


def whole(profile):
    return {r["name"]: {f: v for f, v in r.asDict().items() if f not in ("sample_values", "position")} for r in profile.collect()}


def mixed(spark, n, start=0):
    rng = random.Random(start)
    rows = [(start + i, rng.choice(["yes", "no", " Yes", None]), f"R$ {rng.randint(1, 9)},00", f"0{rng.randint(1, 9)}/12/2023",
             ", ".join(rng.sample(["net", "hook", "bait", "rod"], 2)), rng.choice(["low", "High", "medium"]), f"c{rng.randint(0, 5)}",
             rng.choice([1.5, float("nan"), None, 2.0]), rng.choice([0, 1]), None, [1, 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, ok string, price string, day string, tags string, level string, kind string, "
                                       "x double, bit int, void string, many array<int>")


def test_halves_of_a_mixed_table(spark, tmp_path):
    a, b = mixed(spark, 300), mixed(spark, 200, 5000)
    state = tl.profile_state(a, str(tmp_path / "a")).merge(tl.profile_state(b), str(tmp_path / "ab"))
    assert whole(state.profile()) == whole(tl.profile(a.unionByName(b)))
    assert whole(ProfileState.load(spark, str(tmp_path / "ab")).profile()) == whole(state.profile())
    assert whole(tl.profile_state(a).profile()) == whole(tl.profile(a))


@pytest.mark.parametrize("name", ["documents", "orders", "part", "events"])
def test_halves_of_given_tables(spark, name):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    a, b = df.randomSplit([0.3, 0.7], 4)
    assert whole(tl.profile_state(a).merge(tl.profile_state(b)).profile()) == whole(tl.profile(df))


def test_empty_parts_and_other_columns(spark):
    a = mixed(spark, 60)
    state = tl.profile_state(a)
    assert whole(state.merge(tl.profile_state(a.limit(0))).profile()) == whole(tl.profile(a))
    assert whole(tl.profile_state(a.limit(0)).merge(state).profile()) == whole(tl.profile(a))
    with pytest.raises(ValueError, match="same columns"):
        state.merge(tl.profile_state(a.drop("x")))


def test_appended_rows(spark):
    """A dataset that grows, also by rows that change what a column means."""
    a, b = mixed(spark, 120), mixed(spark, 80, 900)
    data = tl.Dataset.of(a, {"id": "key"}).append(b)
    assert whole(data.profile) == whole(tl.profile(a.unionByName(b))) and data.descriptions["id"] == "key"
    plain = spark.createDataFrame([(f"w{i}",) for i in range(60)], "t string")
    tagged = spark.createDataFrame([(f"a|b{i % 3}",) for i in range(60)], "t string")
    with pytest.raises(Rescan):
        tl.profile_state(plain).merge(tl.profile_state(tagged)).profile()
    assert whole(tl.Dataset.of(plain).append(tagged).profile) == whole(tl.profile(plain.unionByName(tagged)))
