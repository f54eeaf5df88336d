import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabloom.llm import bpe
from tabloom.llm.queries import QUERIES, table

from .conftest import AWKWARD, SF

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    hashes = np.unique(hashes)
    assert sorted(bpe.PerfectHash(hashes).numbers(hashes).tolist()) == list(range(len(hashes)))
    assert bpe.PerfectHash(hashes[:0]).numbers(hashes[:2]).tolist() == [-1, -1]


def test_codec_is_the_reference(reference):
    own = bpe.Codec(PATH, public_tokenizers.PATTERN)
    chance = random.Random(7)
    letters = "ab 's't \n\t\r\x1c\x1f\x85\xa0 é²½漢字1٣,.!*😀́​İ_"
    texts = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 30))) for _ in range(4000)]
    texts += ["<|endoftext|> and more", "aaaa" * 5000, " " * 3000 + "x"]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_long_texts_and_forgotten_pieces(reference, monkeypatch):
    monkeypatch.setattr(bpe, "_AT_ONCE", 50)
    own = bpe.Codec(PATH, public_tokenizers.PATTERN)
    own.units.size = own.pieces_met.size = 20
    chance = random.Random(5)
    text = " ".join("".join(chance.choice("abcdefgh") for _ in range(chance.randint(1, 90))) for _ in range(3000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_awkward_rows(awkward, reference):
    trip = bpe.round_trip(awkward, PATH, public_tokenizers.PATTERN)
    expected = sorted((hashlib.sha256((t or "").encode()).hexdigest(), len(reference.encode_ordinary(t or "")))
                      for _, t in AWKWARD)
    assert sorted((hashlib.sha256(r["decoded"]).hexdigest(), r["n_tokens"]) for r in trip.collect()) == expected
    encoded = bpe.encode(awkward, PATH, public_tokenizers.PATTERN)
    texts = [bytes(r["decoded"]).decode() for r in bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(texts) == sorted(t or "" for _, t in AWKWARD)
    assert bpe.round_trip(awkward.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_is_the_reference(spark, reference):
    expected = set()
    for r in table(spark, SF, "documents").collect():
        ids = reference.encode_ordinary(r["text"] or "")
        expected.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                      hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op3_byte_bpe"](spark, SF).collect()} == expected
