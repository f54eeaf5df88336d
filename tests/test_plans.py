"""Statistics, reports, engineering and the guided run."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabloom as tl


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", rng.choice(["Sim", "não", None]), f"R$ {rng.randint(1, 99)}", f"{1 + i % 28:02d}/{1 + i % 12:02d}/2023",
             rng.choice(["a, b", "b", "c,a"]), rng.choice(["Low", "high", "Medium"]), rng.random() * 10, None)
            for i in range(300)]
    rows += [(None,) * 8, ("Section", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "`Row Key` string, Paid string, Price string, visitDate string, tags string, "
                                       "level string, score double, _c7 string")


def test_describe_against_pandas(spark):
    rng = random.Random(8)
    pdf = pd.DataFrame({"a": [rng.gauss(0, 1) if i % 7 else None for i in range(200)], "b": range(200),
                        "s": [rng.choice(["x", "y", None]) for _ in range(200)],
                        "t": pd.date_range("2024-01-01 00:00:01", periods=200, freq="37min")})
    df = spark.createDataFrame(pdf.assign(s=pdf.s.where(pdf.s.notna(), None))).withColumn("a", F.nanvl("a", F.lit(None)))
    got = {r.name: r for r in tl.describe(df).collect()}
    expected = pdf.describe(include="all")
    for c in ("a", "b"):
        for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                             ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert abs(got[c][mine] - expected.loc[theirs, c]) < 1e-9
    assert (got["s"]["count"], got["s"].unique, got["s"].top, got["s"].freq) == (
        expected.loc["count", "s"], expected.loc["unique", "s"], expected.loc["top", "s"], expected.loc["freq", "s"])
    assert abs(got["t"].p50 - pdf.t.median().timestamp()) < 1e-3 and got["t"].std is None


def test_type_counts_and_metrics(raw):
    p = tl.profile(raw)
    counts = {r.semantic_type: r.n for r in tl.type_distribution(p).collect()}
    assert sum(counts.values()) == 8 and counts["boolean"] == 1
    # Each type occurs once or equally often: the first column's type wins.
    top = tl.dominant_type(p).first()
    assert top.n == max(counts.values())
    assert tuple(tl.dataset_metrics(raw).first()) == (302, 8)


def test_suggestions(spark, raw):
    rows = [(r.rank, r.columns) for r in tl.suggest(tl.profile(raw)).collect()]
    assert [r[0] for r in rows] == [1, 2, 3, 4] and rows[2][1] == "tags"
    plain = tl.suggest(tl.profile(spark.createDataFrame([("a b c d",)], "v string").union(
        spark.createDataFrame([(f"w{i}",) for i in range(40)], "v string")))).collect()
    assert plain[-1].analysis == "further analyses of interest"


def test_summary_text(raw):
    text = tl.dataset_summary(raw, tl.profile(raw))
    assert text.startswith("302 rows x 8 columns")
    assert "level — ordinal: low → medium → high" in text
    assert "tags — multi_value_tags: sep=',', 3 tags: ['a', 'b', 'c']" in text
    assert "Price — numeric_string: prefix='R$' suffix=''" in text
    assert "Paid — boolean: true=['sim'], false=['não']" in text


def test_dataset_update_keeps_descriptions(spark, raw):
    old = tl.Dataset.of(raw, {"Paid": "whether paid", "level": "urgency"}, view="visits")
    assert old.descriptions["Price"] == "" and spark.table("visits").count() == 302
    new = old.update(raw.drop("level").withColumn("extra", F.lit(1)))
    assert new.descriptions == {**{c: "" for c in new.df.columns}, "Paid": "whether paid"}
    assert "extra" in spark.table("visits").columns
    assert {r.name: r.description for r in new.table().collect()}["Paid"] == "whether paid"
    with pytest.raises(TypeError):
        old.update(pd.DataFrame())


def test_changes(raw):
    new = raw.drop("level").withColumn("score", F.col("score").cast("string")).withColumn("extra", F.lit(1)).limit(300)
    found = {(r.change, r.item, r.detail) for r in tl.detect_changes(raw, new).collect()}
    assert found == {("column_removed", "level", "string"), ("column_added", "extra", "int"),
                     ("type_changed", "score", "double -> string"), ("row_count", "", "-2")}
    assert tl.detect_changes(raw, raw).count() == 0
    assert [r.change for r in tl.detect_changes(raw, raw.select(*reversed(raw.columns))).collect()] == [
        "columns_reordered"]


def test_quality_report(raw):
    found = {(r.column, r.issue): r.n for r in tl.quality_report(raw).collect()}
    assert found["_c7", "unnamed_header"] == 302 and found["_c7", "empty_column"] == 302
    assert found["Row Key", "messy_header"] == 302
    assert found["*", "empty_row"] == 1 and found["*", "divider_row"] == 1
    assert found["Paid", "untyped_boolean"] == raw.where("Paid is not null").count()
    assert found["tags", "tags_in_cell"] == 300 and found["level", "unordered_scale"] == 300
    assert found["visitDate", "untyped_date"] == 300 and found["Price", "untyped_number"] == 300
    assert ("level", "mixed_types") not in found


def test_mixed_types_and_repeated_header(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "y"), ("K", "V"), ("d", "z")], "k string, v string")
    found = {(r.column, r.issue): r.n for r in tl.quality_report(df).collect()}
    assert found["v", "mixed_types"] == 1 and found["*", "repeated_header"] == 1


def test_engineer(raw):
    df = tl.clean_table(raw)
    assert df.columns == ["row_key", "paid", "price", "visit_date", "tags", "level", "score"] and df.count() == 300
    out = tl.engineer(df, tl.profile(df))
    kinds = dict(out.dtypes)
    assert (kinds["paid"], kinds["price"], kinds["visit_date"], kinds["level_rank"]) == (
        "boolean", "double", "timestamp_ntz", "int")
    assert {"tags_a", "tags_b", "tags_c", "visit_date_weekday", "visit_date_year"} <= set(out.columns)
    assert out.schema["level"].metadata["ordinal_order"] == ["low", "medium", "high"]
    before = {r.row_key: r for r in df.collect()}
    for r in out.collect():
        b = before[r.row_key]
        assert r.paid == (None if b.paid is None else b.paid == "Sim")
        assert r.price == float(b.price[3:]) and r.tags_a == int("a" in b.tags) and r.level == b.level.lower()


def test_engineer_leaves_the_missing_word_out(spark):
    df = spark.createDataFrame([("a,nan",), ("b,c",), ("NaN,a",)], "v string")
    out = tl.engineer(df, tl.profile(df))
    assert out.columns == ["v", "v_a", "v_b", "v_c"]


def test_engineer_applies_to_a_stream(spark, raw, tmp_path):
    """A profile from a batch table turns a stream's rows the same way: the plan holds no state."""
    df = tl.clean_table(raw)
    df.write.parquet(str(tmp_path / "in"))
    p = tl.profile(df)
    stream = tl.engineer(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), p)
    run = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    run.awaitTermination(120)
    batch = tl.engineer(df, p)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300


def test_guided_run(raw):
    run = tl.guided_run(raw)
    assert run.problems == () and run.cleaned.count() == 300
    assert {"key_metrics", "distributions", "histogram:score", "box:price", "correlation", "trend:visit_date", "tags:tags",
            "tag_pairs:tags", "ordinal:level"} <= set(run.tables)
    assert sum(r.n for r in run.tables["histogram:score"]().collect()) == 300
    assert sum(r.n for r in run.tables["ordinal:level"]().collect()) == 300
    for make in run.tables.values():
        make().count()


def test_the_profile_of_the_cleaned_table_is_measured_again_only_where_rows_went(spark, monkeypatch):
    from tabloom.plans import guided

    rows = [(f"ORD-{i}", "Sim" if i % 2 else "não", None, float(i)) for i in range(40)]
    whole = spark.createDataFrame(rows, "`Order ID` string, Paid string, Empty string, `Total Price` double")
    fields = [f for f in tl.profile(whole).columns if f != "sample_values"]
    junk = whole.unionByName(spark.createDataFrame([("---", None, None, None)], whole.schema))
    for df, measured in ((whole, 0), (junk, 1)):
        raw_profile, cleaned = tl.profile(df), guided.clean_table(df)
        expected = tl.profile(cleaned).select(fields).collect()
        calls = []
        monkeypatch.setattr(guided, "profile", lambda t, d, c=calls: c.append(1) or tl.profile(t, d))
        got = guided.profile_of_cleaned(df, raw_profile, cleaned).orderBy("position").select(fields).collect()
        assert got == expected and [r["name"] for r in got] == ["order_id", "paid", "total_price"]
        assert len(calls) == measured


def test_guided_run_goes_on_after_a_failing_row(raw, monkeypatch):
    def fail(df, *_):
        return df.withColumn("bad", F.when(F.rand() >= 0, F.raise_error(F.lit("no such value"))))

    monkeypatch.setattr("tabloom.plans.guided.engineer", fail)
    run = tl.guided_run(raw)
    assert len(run.problems) == 1 and "no such value" in run.problems[0]
    assert run.features.columns == run.cleaned.columns and run.features.count() == 300


def test_long_vocabularies_and_spellings(spark):
    """Nothing about a column depends on how many values it has."""
    df = spark.range(1500).select(
        "id", F.concat(F.lit("tag"), "id", F.lit(", t"), F.col("id") + 1).alias("tags"),
        F.concat(F.lpad(F.lit(""), (F.col("id") % 1100).cast("int"), " "),
                 F.when(F.col("id") % 2 == 0, "yes").otherwise("No")).alias("answer"),
        F.concat(F.lpad(F.lit(""), (F.col("id") % 1300).cast("int"), " "),
                 F.element_at(F.array(F.lit("low"), F.lit("Medium"), F.lit("HIGH")), (F.col("id") % 3 + 1).cast("int")))
        .alias("level"))
    p = tl.profile(df)
    kinds = {r.name: r for r in p.collect()}
    assert [kinds[c].semantic_type for c in ("tags", "answer", "level")] == ["multi_value_tags", "boolean", "ordinal"]
    assert kinds["tags"].tag_vocabulary is None and kinds["tags"].n_tags == 3000
    assert kinds["level"].ordinal_order == ["low", "medium", "high"]
    values = tl.profile_values(df, p)
    assert values.where("name = 'tags'").count() == 3000
    features = tl.engineer(df.select("id", "tags").limit(40), tl.profile(df.select("id", "tags")))
    assert len(features.columns) == 2 + 80
    tables = tl.dashboard_tables(df, df, p)
    assert tables["tags:tags"]().count() == 3000


def test_guided_run_goes_on_after_a_failing_step(raw, monkeypatch):
    def fail(*_):
        raise RuntimeError("no")

    monkeypatch.setattr("tabloom.plans.guided.engineer", fail)
    run = tl.guided_run(raw)
    assert run.problems == ("engineer: no",) and run.features.columns == run.cleaned.columns
