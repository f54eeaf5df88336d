"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, named, texts_in_arrow, write_down

#: Votes of a labeller.
BAD, GOOD, SILENT = 0, 1, 2
LABELLERS = ("marks", "capitals", "echoes", "bars", "shouts", "recurrence", "sentences", "word_length")
#: Size of the hashed feature space, and distinct texts of each weak label that the scorer is fitted on.
DIMENSIONS, SAMPLE = 2048, 2_000
#: Rows of a batch that are worked on at a time.
_ROWS = 256


def _classes() -> np.ndarray:
    """A class per byte: letters, digits, white space, bytes beyond ASCII, and each punctuation mark for itself."""
    table, marks = np.zeros(256, np.int64), 6
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 0
        elif c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 3
        elif c == "\n":
            table[b] = 4
        elif c.isspace() or b < 32 or b == 127:
            table[b] = 5
        else:
            table[b], marks = marks, marks + 1
    return table


_CLASS = _classes()
_ODD = np.array([b < 128 and 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in "_.,;:'\"!?()-" for b in range(256)])


@dataclass
class Measures:
    words: int
    marks: float
    capitals: float
    echoes: float
    bars: float
    shouts: float
    recurrence: float
    sentences: float
    word_length: float


def measure(text: str, data: np.ndarray) -> Measures:
    """Shares in a whole text that the labellers judge and the scorer sees."""
    words = text.split()
    n = len(words)
    if not n:
        return Measures(0, 0, 0, 0, 0, 0, 0, 0, 0)
    upper = int(np.count_nonzero((data >= 65) & (data <= 90)))
    lower = int(np.count_nonzero((data >= 97) & (data <= 122)))
    threes = max(1, n - 2)
    distinct = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    return Measures(
        n, int(np.count_nonzero(_ODD[data])) / n, upper / (upper + lower or 1), sum(map(eq, words, words[1:])) / n,
        words.count("|") / n, text.count("!!") / n, 1 - distinct / threes,
        sum(w[-1] in ".,!?" for w in words) / n, sum(map(len, words)) / n)


def vote(m: Measures) -> tuple[int, ...]:
    """One vote per labeller; those that need some length stay silent on short texts."""
    def judge(bad: bool, good: bool, least: int = 1) -> int:
        return SILENT if m.words < least else BAD if bad else GOOD if good else SILENT

    return (
        judge(m.marks > 0.12, m.marks <= 0.02, 3), judge(m.capitals > 0.35, m.capitals < 0.1, 4),
        judge(m.echoes > 0.15, m.echoes < 0.05, 8), judge(m.bars > 0.05, m.bars == 0, 4),
        judge(m.shouts > 0.1, m.shouts == 0, 3), judge(m.recurrence > 0.45, m.recurrence < 0.1, 20),
        judge(m.sentences > 0.6 or m.sentences == 0, 0.05 < m.sentences < 0.4, 20),
        judge(m.word_length > 7.5 or m.word_length < 3, 4 < m.word_length < 6.5, 20))


def code_of(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v
    return code


def votes_of(code: int) -> tuple[int, ...]:
    votes = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return tuple(reversed(votes))


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: P(good) per pattern, P(vote | class) per labeller, share of good.

    Silence counts as missing. The start, which also acts as a weak prior, says that a labeller seldom calls a good
    text bad and finds some of the bad ones; without it the classes could change places.
    """
    votes = np.array([votes_of(int(c)) for c in codes])
    n = len(LABELLERS)
    start = np.array([[0.4, 0.6], [0.02, 0.98]])  # P(bad vote), P(good vote) for bad and for good texts
    table, good = np.repeat(start[None], n, axis=0), 0.8
    total = counts.sum()
    weight = 0.01 * total + 1
    for _ in range(rounds):
        logs = np.log([1 - good, good])[None, :].repeat(len(codes), axis=0)
        for j in range(n):
            for v in (BAD, GOOD):
                logs += np.where((votes[:, j] == v)[:, None], np.log(table[j, :, v])[None, :], 0.0)
        logs -= logs.max(axis=1, keepdims=True)
        posterior = np.exp(logs)
        posterior /= posterior.sum(axis=1, keepdims=True)
        before = table.copy()
        for j in range(n):
            for k in (0, 1):
                seen = [(counts * posterior[:, k] * (votes[:, j] == v)).sum() + weight * start[k, v] for v in (0, 1)]
                table[j, k] = np.array(seen) / sum(seen)
        good = float(((counts * posterior[:, 1]).sum() + 0.8) / (total + 1))
        if np.abs(table - before).max() < 1e-7:
            break
    return posterior[:, 1], table, good


def features(m: Measures, data: np.ndarray) -> np.ndarray:
    """Hashed features: trigrams of byte classes as square roots of their shares, and shares of words in steps."""
    out = np.zeros(DIMENSIONS, np.float32)
    if len(data) > 2:
        c = _CLASS[data]
        mixed = (((c[:-2] * 64 + c[1:-1]) * 64 + c[2:]) * 2654435761) >> 12
        out += np.sqrt(np.bincount(mixed % DIMENSIONS, minlength=DIMENSIONS) / (len(data) - 2)).astype(np.float32)
    for k, share in enumerate((m.marks, m.capitals, m.echoes, m.bars, m.shouts, m.recurrence, m.sentences)):
        step = min(10, int(min(share, 1.0) * 20)) if m.words >= 8 else 11
        out[(k * 16 + step + 1) * 40503 % DIMENSIONS] += 0.5
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    posteriors: dict[int, float]
    accuracies: dict[str, tuple[float, float]]

    def score(self, m: Measures, data: np.ndarray) -> float:
        if not m.words:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(features(m, data) @ self.weights + self.bias, -50, 50))))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: full gradient steps with momentum, both classes weighing the same."""
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)  # mixed widths would copy x in every round
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    share = min(max(float(y.mean()), 0.01), 0.99)
    weight = y / share + (1 - y) / (1 - share)
    weight = (weight / weight.sum()).astype(np.float32)
    speed_w, speed_b = np.zeros_like(w), np.float32(0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        d = weight * (p - y)
        speed_w = np.float32(0.9) * speed_w - np.float32(1.5) * (x.T @ d + np.float32(1e-5) * w)
        speed_b = np.float32(0.9) * speed_b - np.float32(1.5) * d.sum()
        w, b = w + speed_w, b + speed_b
    return w, float(b)


def _text_and_bytes(value) -> tuple[str, np.ndarray]:
    text = value.as_py() or ""
    return text, np.frombuffer(text.encode(), np.uint8)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [code_of(vote(measure(*_text_and_bytes(t)))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], names=["raw", "code"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features that are not zero, and their places: most are zero, and the driver gets them all."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            places, values = [], []
            for value in batch.column(1)[start:start + _ROWS]:
                text, data = _text_and_bytes(value)
                x = features(measure(text, data), data)
                places.append((at := np.flatnonzero(x)).astype("<u2").tobytes())
                values.append(x[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[start:start + _ROWS], pa.array(places, pa.binary()), pa.array(values, pa.binary())],
                names=["code", "places", "x"])


def fit(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE) -> Model | None:
    """The model of all rows of ``docs``; None for an empty table.

    Every whole text is judged by every labeller. Their accuracies come from the counts of all vote patterns, of which
    there are at most ``3 ** 8``; these counts are what reaches the driver. The scorer is fitted to the posteriors of at
    most ``sample`` distinct texts of each weak label, those with the lowest hashes, so that copies count once.
    """
    read = texts_in_arrow(docs).select(F.xxhash64(F.coalesce(named(text_column), F.lit(""))).alias("raw"), named(text_column).alias("text"))
    judged = write_down(read.mapInArrow(_votes, "raw long, code int"), "quality-votes")
    counted = judged.groupBy("code").agg(F.count("*").alias("n")).collect()
    if not counted:
        return None
    codes, counts = np.array([r["code"] for r in counted]), np.array([r["n"] for r in counted], float)
    posterior, table, _ = estimate(codes, counts)
    known = {int(c): float(p) for c, p in zip(codes, posterior)}
    distinct = judged.groupBy("raw").agg(F.min("code").alias("code"))
    chosen = []
    for side in ([c for c, p in known.items() if p < 0.5], [c for c, p in known.items() if p >= 0.5]):
        if side:
            rows = distinct.filter(F.col("code").isin(side)).orderBy(F.xxhash64("raw"), "raw").limit(sample)
            chosen += [tuple(r) for r in rows.collect()]
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, "raw long, code int"))
    taken = read.join(few, "raw").dropDuplicates(["raw"]).select("code", "text").mapInArrow(
        _features, "code int, places binary, x binary")
    rows = taken.collect()
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["x"], "<f4")
    y = np.array([known[r["code"]] for r in rows])
    weights, bias = fit_scorer(x, y)
    right = {name: (float(table[j, 0, BAD]), float(table[j, 1, GOOD])) for j, name in enumerate(LABELLERS)}
    return Model(weights, bias, known, right)


def _scores(model: Model, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, weak = [], []
            for value in batch.column(at):
                text, data = _text_and_bytes(value)
                m = measure(text, data)
                scores.append(model.score(m, data))
                weak.append(model.posteriors.get(code_of(vote(m)), 0.5) if m.words else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(weak, pa.float64())],
                                             names=names)
    return run


def score(docs: DataFrame, model: Model | None, text_column: str = "text", score_name: str = "quality_score",
          weak_name: str = "weak_label") -> DataFrame:
    """``docs`` with the scorer's probability of a good text and the labellers' posterior, both from 0 to 1.

    All columns stay; the two new ones get a number where their names are taken. A text without any word, null too,
    scores 0. Rows that repeat get equal scores. Without a model (an empty table) the columns are null.
    """
    score_name = free_name(docs.columns, score_name)
    weak_name = free_name([*docs.columns, score_name], weak_name)
    if model is None:
        return docs.withColumns({score_name: F.lit(None).cast("double"), weak_name: F.lit(None).cast("double")})
    schema = T.StructType([*docs.schema.fields, T.StructField(score_name, T.DoubleType()),
                           T.StructField(weak_name, T.DoubleType())])
    at = docs.columns.index(text_column)
    return texts_in_arrow(docs).mapInArrow(_scores(model, at, schema.names), schema)


def keep_good(docs: DataFrame, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the texts that a model fitted on them scores below ``threshold``; all columns stay."""
    scored = score(docs, fit(docs, text_column), text_column)
    return scored.filter(named(scored.columns[-2]) >= threshold).select(*(named(c) for c in docs.columns))
