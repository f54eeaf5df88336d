"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time with skipping over long ones."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_rows
from .common import named, small, spread, texts_in_arrow, write_down

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes in lower case, of which all beyond ASCII are 0x80 or more.
_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items whose terms travel to the tasks at a time, by number and by characters.
BLOCK_ITEMS, BLOCK_CHARACTERS = 2_000, 8_000_000
#: Documents and postings that a task holds inverted at a time; a window of documents is scored as one array.
SEGMENT_ROWS, SEGMENT_POSTINGS, WINDOW = 65_536, 2_000_000, 8_192
#: Lists of up to this share of a segment's documents are short; together they become one accumulator.
SHORT_SHARE = 1 / 16
_NO_ID = -(1 << 63)


def terms_of(text: Column) -> Column:
    """Terms of a text in order, A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _count_terms(vocabulary: dict[bytes, int]):
    """Per document its number of terms, and those of the vocabulary with how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                found = _TERM_BYTES.findall((text.as_py() or "").encode().lower())
                known = sorted((vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary)
                sizes.append(len(found))
                terms.append([t for t, _ in known])
                counts.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])
    return run


def _document_counts(size: int):
    """How many documents of a task hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["term", "df"])
    return run


@dataclass
class Corpus:
    """What a score needs of all documents: their number, their terms, and each term's weight."""

    documents: int
    terms: int
    weights: np.ndarray

    def contributions(self, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What an occurrence of a term adds for each of its weights, in whole numbers rounded down."""
        damping = 25 + 75 * sizes * self.documents // max(self.terms, 1)
        return 1_000_000_000 * counts // (1_000 * counts + 8 * damping)


class Segment:
    """Some documents by ascending id, inverted: per term the places of its documents and what each of them gains."""

    def __init__(self, corpus: Corpus, ids: np.ndarray, present: np.ndarray, sizes: np.ndarray, lengths: np.ndarray,
                 terms: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((ids, present))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.present = ids[order], present[order]
        docs = np.repeat(place, lengths)
        gains = corpus.contributions(np.repeat(sizes, lengths), counts) * corpus.weights[terms]
        order = np.lexsort((docs, terms))
        self.docs, self.gains = docs[order], gains[order]
        terms = terms[order]
        starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(self.gains, starts) if len(starts) else starts
        self.lists = {int(terms[s]): (int(s), int(e), int(m))
                      for s, e, m in zip(starts, [*starts[1:], len(terms)], most) if m > 0}

    def search(self, item: list[tuple[int, int]], best: Best) -> None:
        """Put this segment's best documents for an item's (term, repeats) into ``best``.

        Short lists are summed term by term into one accumulator, a list of documents with their sums and the largest of
        them as its bound. It then is one of the iterators of a document-at-a-time pass that goes through windows of
        documents. Iterators whose bounds together stay below the score to beat bring no candidates: they are only
        looked up at the documents that the others bring and that can still get in, largest bound first.
        """
        short, iterators = [], []
        for term, repeats in item:
            if (found := self.lists.get(term)) is not None:
                start, end, most = found
                own = (self.docs[start:end], self.gains[start:end], repeats, repeats * most)
                (short if end - start <= SHORT_SHARE * len(self.ids) else iterators).append(own)
        if short:
            docs = np.concatenate([d for d, _, _, _ in short])
            gains = np.concatenate([g * r for _, g, r, _ in short])
            order = np.argsort(docs, kind="stable")
            held, starts = np.unique(docs[order], return_index=True)
            sums = np.add.reduceat(gains[order], starts)
            iterators.append((held, sums, 1, int(sums.max())))
        iterators.sort(key=lambda i: i[3])
        bounds = np.cumsum([i[3] for i in iterators])
        for low in range(0, len(self.ids), WINDOW) if iterators else ():
            beat = best.beat()
            if bounds[-1] < beat:
                return
            # The first iterators, whose bounds do not reach the score to beat, bring no candidates.
            passive = int(np.searchsorted(bounds, beat)) if beat > 0 else 0
            scores = np.zeros(min(WINDOW, len(self.ids) - low), np.int64)
            for docs, gains, repeats, _ in iterators[passive:]:
                a, b = np.searchsorted(docs, (low, low + WINDOW))
                scores[docs[a:b] - low] += gains[a:b] * repeats
            left = np.flatnonzero(scores)
            for k in range(passive - 1, -1, -1):
                left = left[scores[left] + bounds[k] >= beat]
                if not len(left):
                    break
                docs, gains, repeats, _ = iterators[k]
                at = np.searchsorted(docs, left + low)
                hit = np.flatnonzero(at < len(docs))
                hit = hit[docs[at[hit]] == left[hit] + low]
                scores[left[hit]] += gains[at[hit]] * repeats
            left = left[scores[left] >= max(beat, 1)]
            if len(left):
                best.add(scores[left], self.present[left + low], self.ids[left + low])


class Best:
    """The highest scores so far, equal ones by ascending id, nulls first."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.scores = self.ids = np.zeros(0, np.int64)
        self.present = np.zeros(0, bool)

    def beat(self) -> int:
        """Lower scores cannot get in; an equal one can, by a lower id."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 0

    def add(self, scores: np.ndarray, present: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate((self.scores, scores))
        present, ids = np.concatenate((self.present, present)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, present, -scores))[:self.most]
        self.scores, self.present, self.ids = scores[order], present[order], ids[order]


def _searched(corpus: Corpus, items: dict[int, list[tuple[int, int]]], most: int):
    """Best documents of a task per item: documents are inverted a segment at a time, what was found sets the bar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {row: Best(most) for row in items}
        held: list[tuple] = []

        def finish() -> None:
            segment = Segment(corpus, *(np.concatenate(c) for c in zip(*held)))
            for row, item in items.items():
                segment.search(item, best[row])
            held.clear()

        rows = postings = 0
        for batch in batches:
            ids, sizes, terms, counts = batch.columns
            lengths = np.diff(terms.offsets.to_numpy())
            held.append((ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                         sizes.to_numpy(zero_copy_only=False), lengths, terms.flatten().to_numpy(zero_copy_only=False),
                         counts.flatten().to_numpy(zero_copy_only=False)))
            rows, postings = rows + len(lengths), postings + int(lengths.sum())
            if rows >= SEGMENT_ROWS or postings >= SEGMENT_POSTINGS:
                finish()
                rows = postings = 0
        if held:
            finish()
        for row, own in best.items():
            if len(own.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own.scores), row)), pa.array(own.ids, mask=~own.present), pa.array(own.scores)],
                    names=["row", "doc_id", "score"])
    return run


def _weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)


def _search_block(docs: DataFrame, items: list, most: int) -> DataFrame:
    """``row, doc_id, score``: for some items (``row, terms``) the best documents of every task."""
    vocabulary: dict[bytes, int] = {}
    wanted = {r["row"]: sorted(Counter(vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r["terms"]).items())
              for r in items}
    counted = docs.mapInArrow(_count_terms(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>")
    # Documents without any of the terms count in the statistics only.
    counted = write_down(counted, "search-postings")
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("documents"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = np.zeros(len(vocabulary), np.int64)
    per_task = counted.select("terms").mapInArrow(_document_counts(len(vocabulary)), "term int, df long")
    for r in per_task.groupBy("term").agg(F.sum("df").alias("df")).collect():
        held[r["term"]] = r["df"]
    corpus = Corpus(whole["documents"], whole["terms"], _weights(whole["documents"], held))
    return counted.filter(F.size("terms") > 0).mapInArrow(_searched(corpus, wanted, most), "row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, most: int = 10, id_column: str = "doc_id", text_column: str = "text",
           item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` its ``most`` documents with the highest scores above 0.

    Terms are those of ``terms_of``, of whole texts. N is the number of documents with a term, L of all terms, n of a
    document's terms, df of the documents with a term, tf of its occurrences in one. A term weighs
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; with ``m = 25 + 75 n N div L`` a document gains that times
    ``1000000000 tf div (1000 tf + 8 m)`` for each occurrence of the term in the item. Equal scores go by ascending
    document id, null first, ranks from one.

    Every row is an item or a document of its own, whether ids are null or repeat. Texts that are null, empty or without a
    term match nothing. Document ids are read as long. Empty tables give an empty result; other columns are not read.

    Documents are counted once per block of items, whose terms are all that travels to the tasks; the driver receives one
    count per term of a block. A task inverts its own documents a segment at a time, so no list is shuffled, and gives back
    at most ``most`` rows per item.
    """
    spark = docs.sparkSession
    kind = items.schema[item_column].dataType.simpleString()
    asked = items.select(named(item_column).alias("item_id"), terms_of(named(item_text)).alias("terms"))
    asked = write_down(asked.filter(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id()), "search-items")
    length = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    seen = asked.agg(F.count("*").alias("n"), F.sum(length).alias("characters")).first()
    if not seen["n"]:
        return local_rows(spark, [], f"item_id {kind}, rank int, doc_id long, score long")
    blocks = max(spread(seen["n"], BLOCK_ITEMS), spread(seen["characters"], BLOCK_CHARACTERS))
    read = texts_in_arrow(docs).select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    found = None
    for block in range(blocks):
        chosen = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "terms").collect()
        if chosen:
            own = write_down(_search_block(read, chosen, most), "search-found")
            found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(small(asked.select("row", "item_id")), "row").select("item_id", "rank", "doc_id", "score")
