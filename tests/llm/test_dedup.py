import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tabloom.llm import exact_dedup, simhash
from tabloom.llm.common import write_down
from tabloom.llm.components import components
from tabloom.llm.queries import QUERIES, table

from .conftest import AWKWARD, SF


def low(text):
    return (text or "").encode().lower()


def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 40, 500).astype(np.uint64) for _ in range(3)]
    parts += [parts[0][:100], np.array([0, 0, 0, (1 << 40) - 1], np.uint64)]
    values, counts = exact_dedup.merge_filters([exact_dedup.build_filter(p, 40) for p in parts])
    expected = Counter(int(v) for p in parts for v in p)
    assert dict(zip(values.tolist(), counts.tolist())) == dict(expected)
    assert (np.diff(values.astype(np.int64)) > 0).all()


def test_a_partition_builds_one_filter_per_block():
    """However its rows come in batches; a fingerprint leaves it once, with its count."""
    rng = np.random.default_rng(2)
    marks = rng.integers(-(1 << 63), 1 << 63, 5_000, dtype=np.int64)
    marks = np.concatenate([marks, np.full(3_000, marks[0])])
    batches = [pa.RecordBatch.from_arrays([pa.array(marks[i:i + 500])], names=["mark"]) for i in range(0, len(marks), 500)]
    for at_once, sets in ((10_000, 1), (4_000, 2)):
        given = list(exact_dedup._filters_of_partition(4, at_once)(iter(batches)))
        assert len(given) == sets and all(b.column(0).to_pylist() == list(range(16)) for b in given)
        total = Counter()
        for batch in given:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for value, count in zip(*exact_dedup.read_filter(data)):
                    total[(block << 60 | int(value)) - (1 << 63)] += int(count)
        assert total == Counter(marks.tolist())
    assert list(exact_dedup._filters_of_partition(4)(iter([]))) == []


def test_exact_groups_of_awkward_rows(awkward):
    rows = exact_dedup.duplicate_groups(awkward).collect()
    groups = {}
    for i, t in AWKWARD:
        groups.setdefault(low(t), []).append(i)
    expected = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep if len(ids) > 1 else i, len(ids), hashlib.sha256(t).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == expected
    assert Counter(r["text_sha256"] for r in rows if r["kept"]) == {hashlib.sha256(t).hexdigest(): 1 for t in groups}


def test_exact_drop_keeps_one_row_of_each_text(awkward):
    left = exact_dedup.drop_duplicates(awkward)
    assert left.columns == awkward.columns
    rows = left.collect()
    assert Counter(low(r["text"]) for r in rows) == {low(t): 1 for _, t in AWKWARD}
    best = {}
    for i, t in AWKWARD:
        best[low(t)] = max(best.get(low(t), -1), -1 if i is None else i)
    assert all((-1 if r["doc_id"] is None else r["doc_id"]) == best[low(r["text"])] for r in rows)


def test_empty_tables(awkward):
    none = awkward.limit(0)
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one_of_each(none).count() == 0


def plain_fingerprint(text):
    words = low(text).split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows, distance=3):
    """Component ids of (doc_id, fingerprint) by comparing all pairs of distinct fingerprints."""
    marks = sorted({f for _, f in rows})
    parent = {f: f for f in marks}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(marks):
        for b in marks[:k]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)


def test_simhash_of_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    expected = brute_force([(i, plain_fingerprint(t)) for i, t in AWKWARD])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == expected
    left = simhash.keep_one_of_each(awkward)
    assert left.columns == awkward.columns
    ids = {c for _, _, c in expected}
    assert {r["doc_id"] for r in left.collect()} == ids


def test_simhash_query_is_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    rows = QUERIES["op2_simhash"](spark, SF).collect()
    expected = brute_force([(i, plain_fingerprint(t)) for i, t in docs])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == expected


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_links_connect_what_all_pairs_connect(spark, distance):
    rng = np.random.default_rng(distance)
    marks = set()
    for base in rng.integers(0, 1 << 63, 40).tolist():
        for _ in range(6):
            base ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            marks.add(base)
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "mark long"), distance).collect()
    mask = (1 << 64) - 1
    assert all(0 < ((r["a"] ^ r["b"]) & mask).bit_count() <= distance for r in links)
    found = components(spark.createDataFrame([(r["a"], r["b"]) for r in links], "a long, b long")).collect()
    root = {r["node"] & mask: r["root"] for r in found}
    got, expected = {}, {}
    for m, (_, _, c) in zip(sorted(marks), sorted(brute_force([(m, m) for m in marks], distance).elements())):
        expected.setdefault(c, set()).add(m)
        got.setdefault(root.get(m, ("alone", m)), set()).add(m)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[1000 + i] for i in range(200)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_any_graph_by_small_plans(spark, monkeypatch):
    """Against union-find; the plan of a round, which the driver holds, reads the edges of the last one few times."""
    rng, plans = random.Random(5), []
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(900 + k % 7, 900) for k in range(30)]
    parent = {n: n for pair in pairs for n in pair}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    def recorded(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write_down(df, label)

    monkeypatch.setattr("tabloom.llm.components.write_down", recorded)
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    loops = {a for a, b in pairs if a == b} - {n for a, b in pairs if a != b for n in (a, b)}
    assert {r["node"]: r["root"] for r in found.collect()} == {n: find(n) for n in parent if n not in loops}
    assert len(plans) > 2 and all(plan.count("Relation") <= 6 for plan in plans[1:])
