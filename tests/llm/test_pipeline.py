import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from tabloom.llm import exact_dedup, quality
from tabloom.llm.queries import MIX, table

from .conftest import AWKWARD, SF
from .test_bpe import reference  # noqa: F401
from .test_dedup import brute_force, low, plain_fingerprint


def test_stages_against_brute_force(spark, reference):  # noqa: F811
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = exact_dedup.write_down(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, distinct, single, mixed = kept

    model = quality.fit(table(spark, SF, "documents"))
    scored = quality.score(table(spark, SF, "documents"), model).collect()
    assert set(good) == {r["doc_id"] for r in scored if r["quality_score"] >= 0.5}

    best = {}
    for i, t in good.items():
        best[low(t)] = max(i, best.get(low(t), -1))
    assert set(distinct) == set(best.values())

    components = brute_force([(i, plain_fingerprint(t)) for i, t in distinct.items()])
    assert set(single) == {c for _, _, c in components}

    assert mixed == single  # languages are raised, nothing is left out
    repeated = {}
    for r in docs.collect():
        repeated[r["lang"]] = repeated.get(r["lang"], 0) + 1
    assert set(repeated) <= set(MIX)

    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(final) == docs.count()
    for r in final[:50]:
        text = mixed[r["doc_id"]]
        assert r["n_tokens"] == len(reference.encode_ordinary(text)) == len(r["ids"]) // 4
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_runs_through(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["n_tokens"] >= 0 for r in rows)


@pytest.fixture(scope="module")
def awkward_documents(spark):
    """Documents with nulls in every column, ties, repeated rows, long texts, and columns named like those inside."""
    rows = [(i, t, lang, source, n, f"extra {k}", k) for k, ((i, t), lang, source, n) in enumerate(zip(
        AWKWARD, ["en", None, "de", "en", "xx"] * 9, ["a", "b", None] * 9, [None, 1, 2] * 9))]
    names = "doc_id long, text string, lang string, source string, n_chars long, copies string, row int"
    return spark.createDataFrame(rows + rows[:3], names).withColumnRenamed("row", "_raw")


@pytest.mark.parametrize("number", range(5))
def test_each_stage_on_awkward_rows(spark, awkward_documents, number):
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, awkward_documents, SF)
    before = Counter(map(tuple, awkward_documents.collect()))
    rows = got.collect()
    if number < 4:
        assert got.columns == awkward_documents.columns
        assert set(map(tuple, rows)) <= set(before)
    if name == "quality classifier":
        assert all((r["text"] or "").split() for r in rows)
        assert Counter(map(tuple, rows)) <= before
    if name == "exact dedup":
        assert Counter(low(r["text"]) for r in rows) == {low(t): 1 for _, t in AWKWARD}
    if name == "SimHash near-dedup":
        components = brute_force([(k, plain_fingerprint(t.decode())) for k, t in enumerate(dict.fromkeys(low(t) for _, t in AWKWARD))])
        # A document is its id: the row that repeats one stays with it.
        assert len({(r["doc_id"], r["text"]) for r in rows}) == len({c for _, _, c in components}) == len(rows) - 1
    if name == "mixing to target weights":
        assert Counter(map(tuple, rows)) >= before
    if name == "byte-level BPE":
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in awkward_documents.collect())
    empty = stage(spark, awkward_documents.limit(0), SF)
    assert empty.columns == got.columns and empty.count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
