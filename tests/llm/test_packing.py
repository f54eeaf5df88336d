import itertools
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import packing
from tabloom.llm.queries import QUERIES, table

from .conftest import AWKWARD, SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def fewest(lengths, capacity):
    """The least number of bins by trying all ways."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[k]:
                left = list(bins)
                left.remove(room)
                place(k + 1, [*left, room - lengths[k]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best


def test_bounds_hold_and_best_fit_fits():
    rng = random.Random(4)
    met = 0
    for _ in range(300):
        capacity = rng.choice([7, 10, 20, 100])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        bound = packing.lower_bound(*np.unique(lengths, return_counts=True), capacity)
        least = fewest(lengths, capacity)
        met += bound == least
        for way in (packing.best_fit_decreasing, packing.fullest_bins):
            bins, offsets = way(np.array(lengths), capacity)
            assert bound <= least <= bins.max() + 1
            for b in set(bins.tolist()):
                own = sorted((o, n) for k, o, n in zip(bins, offsets, lengths) if k == b)
                assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
                assert sum(n for _, n in own) <= capacity
    assert met > 280
    # Seven pieces of just over a half: the sum says four, the functions seven.
    assert packing.lower_bound(np.array([51]), np.array([7]), 100) == 7
    assert packing.lower_bound(np.array([34]), np.array([6]), 100) == 3
    assert packing.lower_bound(np.array([], int), np.array([], int), 100) == 0


def test_ids_are_those_of_tokenizers(tokenizer):
    """Every token of the vocabulary as a text, and texts of all planes, by both ways."""
    own = packing.Encoder(PATH, public_tokenizers.PATTERN)
    assert own.fast is not None
    with open(PATH, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte_of = packing._byte_characters()
    raw = [bytes(byte_of[c] for c in t) for t in vocabulary if t != "<|endoftext|>"]
    texts = [t for t in (b.decode("utf-8", "ignore") for b in raw) if t]
    assert sum(packing._PLAIN.fullmatch(t) is not None for t in texts) > 45_000
    rng = random.Random(6)
    pool = [*map(chr, range(1, 0x250)), *"漢字😀 　\x85٠ßàйع", " ", " ", "\n", "<|endoftext|>", "'s", "'ll"]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices([c for c in pool if packing._PLAIN.fullmatch(c)], k=80)) for _ in range(3000)]
    got = own.ids(texts)
    expected = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(g.tolist() == e.ids for g, e in zip(got, expected))


def check(rows, texts, tokenizer, capacity, keyed=True):
    """Pieces cover their documents, sequences have no gaps and do not overflow."""
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        assert sum(n for _, n in own) <= capacity
    if keyed:
        assert set(pieces) == set(texts)
        for i, own in pieces.items():
            ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [2]
            own.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
            assert sum(r["length"] for r in own) == len(ids)
            assert all(r["length"] == capacity for r in own[1:])
            for r in own:
                part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
                assert zlib.crc32(part) == r["ids_crc32"]
    return len(sequences)


def test_query(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op12_best_fit_packing"](spark, SF).collect()
    used = check(rows, texts, tokenizer, 1024)
    assert used <= bound_of(rows) + 1


def bound_of(rows):
    lengths = Counter(r["length"] for r in rows)
    return packing.lower_bound(np.array(list(lengths)), np.array(list(lengths.values())), 1024)


def test_more_documents_come_near_the_bound(spark, tokenizer):
    rows = QUERIES["op12_best_fit_packing"](spark, "/root/testdata/sf0.01").collect()
    assert check(rows, {}, tokenizer, 1024, keyed=False) <= 1.003 * bound_of(rows)


def test_exchange_between_partitions(spark, tokenizer):
    """Small partitions waste; what they exchange brings the number of sequences down to the bound."""
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = packing.token_pieces(docs, PATH, public_tokenizers.PATTERN)
    pieces = packing.write_down(pieces.withColumn("mark", F.monotonically_increasing_id()), "test")
    rest = pieces.filter("length < 1024")
    alone = packing._bins(packing._pack_once(rest, rest.count(), 1024, 0, 12))
    packed = packing.pack_pieces(pieces, 1024, each=12)
    rows = packed.collect()
    used = check(rows, texts, tokenizer, 1024)
    bound = packing.global_bound(rest, 1024)
    shared = used - pieces.filter("length = 1024").count()
    assert bound <= shared < alone
    assert shared - bound <= (alone - bound) / 2
    assert Counter((r["doc_id"], r["piece"]) for r in rows) == Counter(tuple(r) for r in pieces.select("doc_id", "piece").collect())


def test_awkward_rows(spark, awkward, tokenizer):
    packed = packing.pack(awkward.withColumn("mark", F.lit("taken")), PATH, public_tokenizers.PATTERN, 64, keep_ids=True)
    rows = packed.collect()
    check(rows, {}, tokenizer, 64, keyed=False)
    expected = Counter()
    for i, t in AWKWARD:
        expected[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == expected
    whole = packing.sequences(packing.write_down(packed, "test")).collect()
    assert {r["sequence_id"] for r in whole} == {r["sequence_id"] for r in rows}
    ids = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in rows}
    for r in whole:
        assert len(r["ids"]) == 4 * r["n_tokens"] <= 256
        assert bytes(r["ids"]) == b"".join(ids[r["sequence_id"], o] for o in r["starts"])
    empty = packing.pack(awkward.limit(0), PATH, public_tokenizers.PATTERN)
    assert empty.count() == 0 and "offset" in empty.columns
