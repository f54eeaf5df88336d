"""Mixing towards target weights with soft membership: posteriors by a classifier, rates by projected gradients.

DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, named, small, write_down

#: Labelled rows the classifier is fitted on, and hashed words it tells apart.
SAMPLE, BUCKETS = 20_000, 1 << 14
#: Correlation of a hashed word with a domain from which on it counts, whatever the number of labels, and log odds.
#: Words a little more frequent somewhere would add up to certainty, as texts hold many; copies make rare ones look so.
_CORRELATED, _TELLING = 0.15, 1.0
_TEMPERATURES = (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0)


def hashed_words(text: Column) -> Column:
    """Runs of letters, of digits and of other marks, in lower case, as numbers below ``BUCKETS``."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(BUCKETS)).cast("int"))


@dataclass
class Classifier:
    """Log odds of significant hashed words per domain, the domains' priors and the temperature of the posterior."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    weights: dict[int, tuple[float, ...]]
    silent: tuple[float, ...]
    temperature: float = 1.0

    def hits(self, words: Column) -> Column:
        """The distinct significant words of a text, numbered from one."""
        place = [0] * BUCKETS
        for k, bucket in enumerate(sorted(self.weights), 1):
            place[bucket] = k
        # Folded to one constant array by the optimizer; as text the expression itself stays small.
        places = F.split(F.lit(",".join(map(str, place))), ",").cast("array<int>")
        return F.array_distinct(F.filter(F.transform(words, lambda w: F.get(places, w)), lambda k: k > 0))

    def scores(self, hits: Column) -> list[Column]:
        """Per domain the mean weight of ``hits``, which come together in a text, or one weight for a text without any."""
        order, sums = sorted(self.weights), []
        for d in range(len(self.domains)):
            values = F.split(F.lit(",".join(["0.0", *(f"{self.weights[b][d]:.3f}" for b in order)])), ",").cast("array<double>")
            found = F.aggregate(F.transform(hits, partial(F.get, values)), F.lit(0.0), lambda a, w: a + w)
            sums.append(F.when(F.size(hits) == 0, F.lit(self.silent[d])).otherwise(found / F.size(hits)))
        return sums

    def posteriors(self, scored: DataFrame, heat: Column | None = None) -> DataFrame:
        """``scored``, which has a score per domain in ``s0, s1, ...``, with the posteriors ``p0, p1, ...``.

        Logits, exponentials and their sum are columns on the way. Written out for each posterior they would stand in it
        once per domain and again, and the plan, which the driver holds, would be as large.
        """
        heat = F.lit(self.temperature) if heat is None else heat
        count = range(len(self.domains))
        logits = [F.lit(math.log(max(p, 1e-9))) + heat * F.col(f"s{k}") for k, p in enumerate(self.priors)]
        steps = scored.select("*", *(x.alias(f"l{k}") for k, x in enumerate(logits)))
        steps = steps.withColumn("most", F.greatest(*(f"l{k}" for k in count)) if len(count) > 1 else F.col("l0"))
        steps = steps.select("*", *(F.exp(F.col(f"l{k}") - F.col("most")).alias(f"e{k}") for k in count))
        steps = steps.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"e{k}") for k in count]))
        return steps.select(*scored.columns, *((F.col(f"e{k}") / F.col("total")).alias(f"p{k}") for k in count))


def _odds(inside: int, size: int, everywhere: int, total: int) -> float:
    """How much more frequent something is in a domain than in the rest, as a logarithm within plus and minus five."""
    odds = math.log(((inside + 0.5) / (size + 1)) / ((everywhere - inside + 0.5) / (total - size + 1)))
    return max(-5.0, min(5.0, odds))


def _correlation(inside: int, size: int, everywhere: int, total: int) -> float:
    """Correlation of holding a word with being in a domain, over labelled rows."""
    spread = size * (total - size) * everywhere * (total - everywhere)
    return (inside * total - everywhere * size) / math.sqrt(spread) if spread else 0.0


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], id_column: str = "doc_id",
                   text_column: str = "text", sample: int = SAMPLE) -> Classifier:
    """A classifier from ``labelled`` (``doc_id, domain``): at most ``sample`` of its rows, those with the lowest hashes.

    What reaches the driver are counts per hashed word and domain. Labels that are null, not among ``domains`` or
    without a document do not count; where none is left all domains are equally likely for every text.
    """
    domains = tuple(domains)
    chosen = (labelled.filter(F.col("domain").isin(list(domains))).select(F.col("doc_id").alias("_labelled"), "domain")
              .dropDuplicates(["_labelled"]).orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample))
    words = (docs.select(named(id_column).alias("_id"), named(text_column).alias("_text"))
             .join(F.broadcast(chosen), F.col("_id") == F.col("_labelled"))
             .select("domain", hashed_words(F.col("_text")).alias("words")))
    words = write_down(words, "mixing-labelled")
    sizes = {r["domain"]: r["n"] for r in words.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier(domains, tuple(1 / len(domains) for _ in domains), {}, tuple(0.0 for _ in domains))
    counted = (words.select("domain", F.explode(F.array_distinct("words")).alias("word")).groupBy("word")
               .agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains))).collect())
    weights = {}
    for row in counted:
        counts = row[1:]
        everywhere = sum(counts)
        logs, telling = [], False
        for k, d in enumerate(domains):
            n, rest = sizes.get(d, 0), total - sizes.get(d, 0)
            if not n or not rest:
                logs.append(0.0)
                continue
            odds = _odds(counts[k], n, everywhere, total)
            telling |= _correlation(counts[k], n, everywhere, total) >= _CORRELATED and odds >= _TELLING
            logs.append(odds)
        if telling:
            weights[row["word"]] = tuple(logs)
    priors = tuple(sizes.get(d, 0) / total for d in domains)
    none = tuple(0.0 for _ in domains)
    fitted = Classifier(domains, priors, weights, none)
    hits = write_down(words.select("domain", fitted.hits(F.col("words")).alias("hits")), "mixing-hits")
    empty = {r["domain"]: r["n"] for r in hits.groupBy("domain").agg(F.count_if(F.size("hits") == 0).alias("n")).collect()}
    fitted.silent = tuple(
        _odds(empty.get(d, 0), sizes.get(d, 0), sum(empty.values()), total) if sizes.get(d, 0) else 0.0 for d in domains)
    scored = hits.select("domain", *(s.alias(f"s{k}") for k, s in enumerate(fitted.scores(F.col("hits")))))
    # A row per temperature, so that the plan holds the posteriors once.
    tried = fitted.posteriors(scored.select("*", F.explode(F.array(*map(F.lit, _TEMPERATURES))).alias("heat")), F.col("heat"))
    own = reduce(lambda a, x: F.when(F.col("domain") == x[1], F.col(f"p{x[0]}")).otherwise(a), enumerate(domains), F.lit(1.0))
    losses = tried.select("heat", (-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss"))
    found = losses.agg(*(F.avg(F.when(F.col("heat") == t, F.col("loss"))).alias(f"t{k}")
                         for k, t in enumerate(_TEMPERATURES))).first()
    fitted.temperature = min(zip(found, _TEMPERATURES))[1]
    return fitted


def membership(docs: DataFrame, classifier: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, raw, n_tokens, p_<domain>...`` per row: a hash of the text, its words and its posteriors."""
    text = F.coalesce(named(text_column), F.lit(""))
    read = docs.select(named(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"),
                       hashed_words(text).alias("words"))
    read = read.select("doc_id", "raw", F.size("words").cast("long").alias("n_tokens"),
                       classifier.hits(F.col("words")).alias("hits"))
    read = read.select("doc_id", "raw", "n_tokens",
                       *(s.alias(f"s{k}") for k, s in enumerate(classifier.scores(F.col("hits")))))
    return classifier.posteriors(read).select(
        "doc_id", "raw", "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(classifier.domains)))


@dataclass
class Rates:
    """Steps that lead from rates of one to the fitted ones, the totals per domain they reach and those they should."""

    domains: tuple[str, ...]
    lowest: float
    most: float | None
    steps: list[tuple[float, ...]]
    totals: dict[str, float]
    goal: dict[str, float]

    def column(self) -> Column:
        """A document's rate: each step moves it by its posteriors and back into the bounds. The steps are one constant."""
        if not self.steps:
            return F.lit(1.0)
        member = F.array(*(named(f"p_{d}") for d in self.domains))
        steps = F.split(F.lit(";".join(",".join(f"{v:.17g}" for v in s) for s in self.steps)), ";")
        vectors = F.transform(steps, lambda s: F.split(s, ",").cast("array<double>"))

        def moved(rate: Column, step: Column) -> Column:
            way = F.aggregate(F.zip_with(member, step, lambda p, v: p * v), F.lit(0.0), lambda a, v: a + v)
            bounded = F.greatest(F.lit(self.lowest), rate - way)
            return bounded if self.most is None else F.least(F.lit(float(self.most)), bounded)

        return F.aggregate(vectors, F.lit(1.0), moved)

    def off(self) -> float:
        """How far the farthest domain is from its target, as a share of it."""
        return max((abs(self.totals[d] - g) / g for d, g in self.goal.items() if g > 0), default=0.0)


def fit_rates(members: DataFrame, targets: Mapping[str, float], total_tokens: float | None = None,
              most: float | None = None, rounds: int = 60, tolerance: float = 1e-3) -> Rates:
    """The rate of each row of ``members`` (a written table).

    Least squares on the domains' expected token totals: rates start at one and take projected gradient steps. A step is
    one number per domain, so what a task needs is the list of steps so far; a round is one aggregate over the table.

    Without ``total_tokens`` no document is left out: rates stay at one or above, and the total is the least so far at
    which no domain would have to shrink, so it rises with the tokens that documents of other domains bring along. Steps
    are then scaled by the products of the posteriors of documents that are free to move. With ``total_tokens`` rates lie
    above zero and steps are plain ones, measured by a document's tokens, which always descend. ``most`` bounds rates.

    It ends when all totals are within ``tolerance`` of their targets. As those may be out of reach, it also ends when plain
    steps change no total, and when ten scaled ones came no nearer; the rates that came nearest then count. ``off`` tells
    how near that is.
    """
    domains = tuple(targets)
    shares = {d: targets[d] / sum(targets.values()) for d in domains}
    lowest = 1.0 if total_tokens is None else 0.0
    mass = {d: F.col("n_tokens") * named(f"p_{d}") for d in domains}
    pairs = [(a, b) for i, a in enumerate(domains) for b in domains[i:]]
    now = Rates(domains, lowest, most, [], {}, {})
    best, start, before, total, waited = None, None, None, total_tokens or 0.0, 0
    for _ in range(rounds + 1):
        rate = F.col("rate")
        free = F.lit(not now.steps) | ((rate > lowest) & (F.lit(True) if most is None else rate < float(most)))
        row = members.withColumn("rate", now.column()).agg(
            *(F.coalesce(F.sum(mass[d] * rate), F.lit(0.0)).alias(f"t_{d}") for d in domains),
            *(F.coalesce(F.sum(F.when(free, mass[a] * named(f"p_{b}"))), F.lit(0.0)).alias(f"g{i}")
              for i, (a, b) in enumerate(pairs))).first()
        now.totals = {d: row[f"t_{d}"] for d in domains}
        start = start or dict(now.totals)
        open_ = [d for d in domains if start[d] > 0]
        if not any(shares[d] > 0 for d in open_):
            return now
        if total_tokens is None:
            total = max(total, *(now.totals[d] / shares[d] for d in open_ if shares[d] > 0))
        now.goal = {d: total * shares[d] for d in open_}
        if best is None or now.off() < 0.99 * best.off() or now.off() <= tolerance:
            best, waited = replace(now, steps=list(now.steps)), 0
        waited += 1
        if now.off() <= tolerance or len(now.steps) == rounds:
            break
        if waited > 10 if total_tokens is None else before and all(abs(before[d] - now.totals[d]) <= 1e-5 * total for d in open_):
            break
        before = now.totals
        gap = np.array([now.totals[d] - now.goal[d] if d in now.goal else 0.0 for d in domains])
        if total_tokens is None:
            products = np.zeros((len(domains), len(domains)))
            for i, (a, b) in enumerate(pairs):
                products[domains.index(a), domains.index(b)] = products[domains.index(b), domains.index(a)] = row[f"g{i}"]
            step = np.linalg.lstsq(products, gap, rcond=1e-6)[0]
        else:
            step = np.array([g / start[d] if start[d] > 0 else 0.0 for g, d in zip(gap, domains)])
        now.steps.append(tuple(step.tolist()))
    return now if total_tokens is not None else best


def copies(rate: Column, *key: Column) -> Column:
    """A whole number whose expectation is the rate; the same for the same key."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + chance).cast("int")


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_column: str = "doc_id",
                 text_column: str = "text", total_tokens: float | None = None, most: float | None = None,
                 tolerance: float = 1e-3, strict: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, raw, n_tokens, p_<domain>..., rate, copies, off_target``.

    ``labelled`` (``doc_id, domain``) trains the classifier, ``targets`` maps domains to weights. Null counts as the
    empty text, which has no tokens and the priors as its posteriors. Rows that repeat get equal rates and, with equal
    ids, equal copies. An empty table gives an empty result; a domain that no text belongs to is left out of the fit.

    ``off_target`` is the same for all rows: how far the farthest domain stays from its target, as a share of it. Where
    texts cannot be told apart, targets may be out of reach; ``strict`` then raises an error. Unless ``total_tokens`` is
    given every rate is at least one, so no row is left out.
    """
    classifier = fit_classifier(docs, labelled, list(targets), id_column, text_column)
    members = write_down(membership(docs, classifier, id_column, text_column), "mixing-members")
    fitted = fit_rates(members, targets, total_tokens, most, tolerance=tolerance)
    if strict and fitted.off() > tolerance:
        raise ValueError(f"targets are out of reach: totals {fitted.totals} instead of {fitted.goal}")
    return members.withColumn("rate", fitted.column()).withColumns(
        {"copies": copies(F.col("rate"), F.col("doc_id"), F.col("raw")), "off_target": F.lit(fitted.off())})


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_column: str = "doc_id",
        text_column: str = "text", total_tokens: float | None = None, most: float | None = None) -> DataFrame:
    """``docs`` with every row repeated or left out as its rate says; all columns stay, whatever their names.

    Only rows whose number of copies is not one are joined to ``docs``.
    """
    rates = mixing_rates(docs, labelled, targets, id_column, text_column, total_tokens, most)
    id_, raw_, times = (free_name(docs.columns, n) for n in ("_mixed_id", "_mixed_raw", "_copies"))
    changed = rates.filter("copies <> 1").select(F.col("doc_id").alias(id_), F.col("raw").alias(raw_),
                                                 F.col("copies").alias(times)).distinct()
    changed = write_down(changed, "mixing-changed")
    same = (named(id_column).cast("long").eqNullSafe(F.col(id_))
            & (F.xxhash64(F.coalesce(named(text_column), F.lit(""))) == F.col(raw_)))
    found = docs.join(small(changed), same, "left").withColumn(times, F.coalesce(F.col(times), F.lit(1)))
    again = F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(1), F.col(times))).otherwise(F.array().cast("array<int>")))
    return found.select(*(named(c) for c in docs.columns), again.alias(times)).drop(times)
