import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm import search
from tabloom.llm.queries import QUERIES, table

from .conftest import AWKWARD, SF

TERM = re.compile(search.TERM)
LOWER = str.maketrans(search._UPPER, search._LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, most=10):
    """Every document against every item; the items' rows by number."""
    counted = [(i, len(t), Counter(t)) for i, t in ((i, terms(x)) for i, x in docs)]
    whole = sum(n > 0 for _, n, _ in counted)
    length = sum(n for _, n, _ in counted)
    df = Counter(t for _, _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, n, c in counted:
            if n:
                m = 100 - 75 + 75 * n * whole // length
                score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1)))
                            * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
                if score > 0:
                    scores.append((-score, i is not None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores, key=lambda s: s[:3])[:most], 1):
            out[item, rank, i, -score] += 1
    return out


def found(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = QUERIES["op13_lexical_search"](spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert found(got) == plain(docs, items)


def zipf_texts(rng, n, most=60):
    words = [f"w{k}" for k in range(200)]
    weights = [1 / (k + 1) for k in range(200)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("rows", "window", "short"), [(64, 16, 1 / 16), (1000, 32, 0.0), (50, 7, 1.0), (333, 100, 0.3)])
def test_short_and_long_lists(spark, monkeypatch, rows, window, short):
    """However lists are split between accumulators and iterators, segments and windows, the result is the same."""
    for name, value in (("SEGMENT_ROWS", rows), ("WINDOW", window), ("SHORT_SHARE", short)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(rows)
    docs = list(enumerate(zipf_texts(rng, 900)))
    docs += [(2000 + i, docs[3][1]) for i in range(300)]  # a third is one text: scores tie
    rng.shuffle(docs)
    items = [(i, t) for i, t in enumerate(zipf_texts(rng, 25, 15))] + [(100, docs[3][1])]

    # In this process, where the parameters above hold, over batches of some rows.
    import pyarrow as pa

    vocabulary, wanted = {}, {}
    for k, (_, text) in enumerate(items):
        wanted[k] = sorted(Counter(vocabulary.setdefault(t.encode(), len(vocabulary)) for t in terms(text)).items())
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs[a:a + 100]], pa.int64()),
                                           pa.array([t for _, t in docs[a:a + 100]])], names=["doc_id", "text"])
               for a in range(0, len(docs), 100)]
    counted = list(search._count_terms(vocabulary)(iter(batches)))
    sizes = [n for b in counted for n in b.column(1).to_pylist()]
    held = Counter(t for b in counted for own in b.column(2).to_pylist() for t in own)
    whole = sum(n > 0 for n in sizes)
    import numpy as np
    corpus = search.Corpus(whole, sum(sizes), search._weights(whole, np.array([held[t] for t in range(len(vocabulary))])))
    got = Counter()
    for batch in search._searched(corpus, wanted, 10)(iter(counted)):
        for rank, (row, doc, score) in enumerate(zip(*(c.to_pylist() for c in batch.columns)), 1):
            got[items[row][0], rank, doc, score] += 1
    assert got == plain(docs, items)


def test_awkward_rows(spark, awkward, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ITEMS", 3)
    items = [(1, "hello WORLD hello"), (1, "hello WORLD hello"), (2, None), (3, ""), (4, " .,; "), (None, "É 漢字 word"),
             (5, "nowhere"), (6, "x" * 100_000), (7, "only " * 5000), (8, "big, text!")]
    df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = search.search(awkward.withColumn("n", F.lit("taken")), df, most=4)
    assert found(got) == plain(AWKWARD, items, 4)
    assert search.search(awkward.limit(0), df).count() == 0
    assert search.search(awkward, df.limit(0)).count() == 0
    assert search.search(awkward, df.filter("item_id in (2, 3, 4)")).count() == 0


def test_rows_of_the_result_belong_to_their_item(spark):
    docs = [(i, f"alpha beta{i} gamma{i % 3}") for i in range(40)]
    items = [(9, "beta3 gamma1"), (8, "gamma2"), (7, "alpha")]
    got = search.search(spark.createDataFrame(docs, "doc_id int, text string").repartition(7),
                        spark.createDataFrame(items, "item_id string, text string"))
    by_item = defaultdict(list)
    for r in got.collect():
        by_item[r["item_id"]].append((r["rank"], r["doc_id"]))
    assert sorted(by_item["9"])[0] == (1, 3) and [d % 3 for _, d in by_item["8"]] == [2] * 10
    # Equal scores go by id.
    assert sorted(by_item["7"]) == [(k + 1, k) for k in range(10)]
