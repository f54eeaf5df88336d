"""Sharding, conversations, fingerprints, lines, pages."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import chat, html_text, line_dedup, order_minhash, ranks, sharding
from tabloom.llm.queries import ORACLES, QUERIES, table

from .conftest import AWKWARD, SF


def check_law(rows, texts, shards=8):
    """Law ``rows``: counts at most one apart, slots gapless, sizes and checksums those of the texts."""
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts.get(s, 0)))
    data = [(t or "").encode() for t in texts]
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len(t) + 1, zlib.crc32(t)) for t in data)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_sharding_of_awkward_rows(awkward):
    rows = sharding.balanced_shards(awkward, 3).collect()
    assert len(rows) == len(AWKWARD)
    check_law(rows, [t for _, t in AWKWARD], 3)
    assert sharding.balanced_shards(awkward.limit(0)).count() == 0


def test_a_group_beyond_a_shard_takes_few_shards(documents):
    texts = ["same"] * 100 + [f"pair {i // 2}" for i in range(100)] + [f"own {i}" for i in range(103)]
    rows = sharding.balanced_shards(documents(list(enumerate(texts))), 8).collect()
    check_law(rows, texts)
    of = {}
    for r in rows:
        of.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(of["same"]) <= 4  # 100 of 303 rows need three shards
    assert sum(len(s) > 1 for t, s in of.items() if t.startswith("pair")) <= 2


def test_all_rows_in_groups_still_fit(documents):
    texts = [f"t{i // 3}" for i in range(101)]
    rows = sharding.balanced_shards(documents(list(enumerate(texts))), 4).collect()
    check_law(rows, texts, 4)


@pytest.mark.parametrize(("groups", "alone"), [(20, 200), (120, 200), (120, 0)])
def test_propagation_gathers_groups(documents, groups, alone):
    """The start knows no groups: moves grow with their number, and every round cuts fewer links; full shards swap."""
    texts = [f"group {i % groups}" for i in range(groups * 5)] + [f"own {i}" for i in range(alone)]
    rounds = []
    rows = sharding.balanced_shards(documents(list(enumerate(texts))), 8,
                                    seen=lambda pieces, moves: rounds.append((sharding.cut_edges(pieces), moves))).collect()
    check_law(rows, texts)
    cuts = [c for c, _ in rounds]
    assert all(a > b for a, b in zip(cuts, cuts[1:]))
    moves = sum(m for _, m in rounds)
    assert 2 * groups < moves < 8 * groups
    assert cuts[-1] <= (0 if alone else groups * 10 * 0.3)


def test_slices_grow_with_the_square_root():
    assert ranks.slice_bits(4_000) == 0 and 2 ** ranks.slice_bits(10**6) <= 512
    assert 2 ** ranks.slice_bits(10**11) <= 2 * 10**5.5 * 2


def test_admitted_moves_keep_the_capacity():
    # Two full shards swap; a third has room for some of what asks.
    assert sharding.admitted({(0, 1): 5, (1, 0): 3, (0, 2): 4}, [10, 10, 8], [10, 10, 10]) == {(0, 1): 3, (1, 0): 3, (0, 2): 2}
    assert sharding.admitted({(0, 1): 5}, [10, 10], [10, 10]) == {}
    assert sharding.admitted({(0, 1): 5, (1, 2): 5, (2, 0): 5}, [9, 9, 9], [9, 9, 9]) == {(0, 1): 5, (1, 2): 5, (2, 0): 5}


def test_add_shards(documents, spark):
    df = documents([(None, "a"), (1, "a"), (2, None), (3, "b")]).withColumn("shard", F.lit("taken"))
    got = sharding.add_shards(df, 2)
    assert got.columns == [*df.columns, "shard_1"] and Counter(r["shard_1"] for r in got.collect()) == {0: 2, 1: 2}
    assert sharding.add_shards(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="2 rows have the doc_id 5"):
        sharding.add_shards(documents([(5, "a"), (5, "b")]), 2)


def test_numbered_without_gaps(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    rows = ranks.numbered(df, ["g"], F.col("id"), 5000, "n", each=100).collect()
    for g in range(3):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))
    assert sorted(r["n"] for r in ranks.numbered(df, [], F.col("id"), 5000, "n", each=100).collect()) == list(range(5000))


TURNS = [
    (1, 0, "user", "a"), (1, 1, "bot", "b"),                                  # begins 2
    (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"),
    (3, 0, "user", "a"), (3, 5, "bot", "b"), (3, 9, "user", "c"),             # equal to 2
    (4, 0, "user", "ab"), (4, 1, "bot", None),
    (5, 0, "user", "ab"), (5, 1, "bot", ""),                                  # null is not empty
    (6, 0, None, "x <|im_end|>"), (6, None, "user", "first"),
    (7, 0, "user", "a"), (7, 0, "user", "a"),                                 # repeated rows are turns
    (None, 0, "user", "nobody"), (None, 1, "bot", "y"),
    (8, 1, "bot", "b"), (8, 0, "user", "z"),
]


def plain_chats(turns):
    """Maximal conversations by comparing all pairs."""
    def first(x):
        return (x is not None, x)

    convs = {}
    for c, t, r, x in turns:
        convs.setdefault(c, []).append((t, r, x))
    lists = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: tuple(map(first, v)))] for c, v in convs.items()}
    out = []
    for c, own in lists.items():
        same = [d for d, other in lists.items() if other == own]
        longer = any(len(o) > len(own) and o[:len(own)] == own for o in lists.values())
        if not longer and c == min(same, key=lambda d: (d is None, d)):
            def plain(x, instead):
                return (instead if x is None else x).replace("<|im_", "<| im_")
            text = "".join(f"<|im_start|>{plain(r, 'unknown')}\n{plain(x, '')}<|im_end|>\n" for r, x in own)
            out.append((c, len(own), len(same), text))
    return Counter(out)


def test_conversations(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string"
    long = [(9, i, "user", f"t{i}") for i in range(40)] + [(10, i, "user", f"t{i}") for i in range(39)]
    df = spark.createDataFrame(TURNS + long, schema)
    assert Counter(map(tuple, chat.collapse_conversations(df).collect())) == plain_chats(TURNS + long)
    monkeypatch.setattr(chat, "BLOCK", 4)
    blocks = df.withColumn("block", F.lit("clash"))
    assert Counter(map(tuple, chat.collapse_conversations(blocks).collect())) == plain_chats(TURNS + long)
    assert chat.collapse_conversations(df.limit(0)).count() == 0


def murmur(value, seed=42):
    """Murmur3 of a long, as the published algorithm has it for 8 bytes."""
    def rot(x, r):
        return (x << r | x >> 32 - r) & 0xFFFFFFFF

    h = seed & 0xFFFFFFFF
    for k in (value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF):
        k = rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def plain_order_minhash(text):
    """The fingerprint by its definition: numbered k-mers, the two least of each bucket, hashed in text order."""
    def mix(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p, h)
        return h & ((1 << 43) - 1)

    units = [u.encode() for u in re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text or "")]
    mers = [mix(*units[i:i + 3]) for i in range(len(units) - 2)] or ([mix(b" ".join(units))] if units else [])
    met, buckets = Counter(), {}
    for at, mer in enumerate(mers):
        own = mix(mer.to_bytes(8, "little"), met[mer].to_bytes(4, "little"))
        met[mer] += 1
        buckets.setdefault(own >> 37, []).append((own, at))
    out = []
    for bucket, own in buckets.items():
        seed = 42
        for value, _ in sorted(sorted(own)[:2], key=lambda e: e[1]):
            seed = murmur(value, seed)
        out.append(bucket << 32 | seed)
    return sorted(out)


def test_fingerprints_by_brute_force(spark, awkward):
    """Signatures recomputed from their definition, over whole texts and awkward ones."""
    rng = random.Random(11)
    repeats = [" ".join(rng.choices("abc", k=rng.randint(1, 300))) for _ in range(30)]
    texts = [t for _, t in AWKWARD] + [r["text"] for r in table(spark, SF, "documents").collect()] + repeats
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["f"] for r in order_minhash.with_fingerprint(df, "t", "f").collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_order_minhash(text), text[:80]


def test_fingerprints_query(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").collect())
    rows = {r["doc_id"]: r for r in QUERIES["op6_order_minhash"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for k, (i, text) in enumerate(docs):
        half, following = len(text) // 2, docs[(k + 1) % len(docs)]
        edited = text[:len(text) - half] + following[1][:half]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, near in ((r["fingerprint"], r["edited_fingerprint"], r["near_edited"]),
                           (r["fingerprint"], rows[following[0]]["fingerprint"], r["near_next"])):
            a, b = ({x[j:j + 10] for j in range(0, len(x), 10)} for x in (a, b))
            buckets = {int(x, 16) >> 32 for x in a | b}
            assert near == (len(a & b) / len(buckets) if buckets else 1.0)


def test_fingerprints_feel_order_and_number(spark):
    base = " ".join(f"w{i}" for i in range(400))
    words = base.split()
    swapped = " ".join(words[200:] + words[:200])
    texts = [base, base, "  " + base.replace(" ", "\n"), swapped, " ".join(words[:390]), base + " " + base]
    df = order_minhash.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", "f")
    got = [r["f"] for r in df.orderBy("id").collect()]
    assert got[0] == got[1] == got[2] and 0 < len(got[0]) <= 64

    def near(a, b):
        return len(set(a) & set(b)) / len({x >> 32 for x in [*a, *b]})

    assert near(got[0], got[4]) > 0.8
    # Swapped halves hold nearly the same k-mers; their order differs.
    assert near(got[0], got[3]) < 0.8
    assert near(got[0], got[5]) < 0.9


def test_fingerprints_of_awkward_rows(awkward, spark):
    rows = order_minhash.edited_neighbours(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert Counter(r["n_chars"] for r in rows) == Counter(len(t or "") for _, t in AWKWARD)
    one = order_minhash.edited_neighbours(spark.createDataFrame([(1, "abcd ef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdabc").hexdigest() and one["near_next"] == 1.0
    assert order_minhash.edited_neighbours(awkward.limit(0)).count() == 0


def test_next_row_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "_RANGE_ROWS", 3)
    ids = [None, 5, 5, *range(10, 60, 3)]
    df = spark.createDataFrame([(i, f"t{k:03}") for k, i in enumerate(ids)], "id long, t string").repartition(4)
    got = order_minhash.with_next(df, "id", {"t": "following"}, "t").collect()
    expected = {(f"t{k:03}", f"t{(k + 1) % len(ids):03}") for k in range(len(ids))}
    assert {(r["t"], r["following"]) for r in got} == expected and len(got) == len(ids)


LETTERS = str.maketrans("0123456789", "ghijklmnop")
LINES = [
    (1, "Posted here by anna on 12 may\nunique words of the first text\nAll rights reserved"),
    (2, "Posted here by bert on 13 june\nother things are said here now\nAll rights reserved"),
    (3, "Posted here by carl on 4 july\nsome more text of its own\nAll rights reserved\n\n"),
    (4, "Posted here by dora on 5 july\nAll rights\n4711"), (5, "x\n4711"), (6, "y\n4711"),
    (7, "again and again\nagain and again"), (7, "again and again\nagain and again"), (8, None), (9, ""),
    (None, "z\n\n\n"),
]


def test_lines(documents):
    rows = {r["doc_id"]: r for r in line_dedup.clean_lines(documents(LINES)).collect()}
    assert rows[1]["text"] == "unique words of the first text" and rows[1]["n_dropped"] == 2
    assert rows[2]["text"] == "other things are said here now"
    assert rows[3]["text"] == "some more text of its own\n\n" and rows[3]["n_lines"] == 5
    assert rows[4]["text"] == "All rights"  # a number that recurs as it is goes, two words recur nowhere else
    assert rows[5]["text"] == "x"
    assert rows[7]["n_dropped"] == 0  # copies of one text count once
    assert rows[8]["text"] == rows[9]["text"] == "" and rows[8]["n_lines"] == 1
    assert line_dedup.clean_lines(documents(LINES)).count() == len(LINES)
    assert line_dedup.clean_lines(documents(LINES).limit(0)).count() == 0


def test_lines_of_awkward_rows(awkward):
    rows = line_dedup.clean_lines(awkward, texts=1, similar=0.0).collect()
    assert len(rows) == len(AWKWARD)


def test_lines_of_few_words_without_digits(documents):
    """They recur word for word, digits or not; lines that differ in a number only are not told to be alike by so few."""
    same = "2024-05-01 12:01:33 10.0.0.1 GET 200 512\nTel  0800 123 456 789"
    texts = [f"{same}\n2024-05-01 12:01:3{i} 10.0.0.1 PUT 200 51{i}" for i in range(4)]
    rows = line_dedup.clean_lines(documents(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {i: t.split("\n")[2] for i, t in enumerate(texts)}


@pytest.mark.parametrize("values", [6, 20, 50])
def test_lines_with_recurring_field_values(documents, values):
    """A template's fields stay fields however many lines hold each value; other lines of the leaf stay."""
    posts = [f"Posted here by name{chr(97 + i // 26)}{chr(97 + i % 26)} from city{chr(97 + j // 26)}{chr(97 + j % 26)} "
             f"for our readers" for i in range(values) for j in range(values)]
    own = [" ".join(["Posted here by", *("w" + hashlib.md5(f"{i}/{k}".encode()).hexdigest().translate(LETTERS)
                                         for k in range(6))]) for i in range(len(posts))]
    texts = [f"{p}\n{o}" for p, o in zip(posts, own)]
    rows = line_dedup.clean_lines(documents(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(own))


def by_sql(df):
    """The rows that the SQL counterpart gives for a table of documents."""
    import duckdb

    db = duckdb.connect()
    db.register("documents", df.select("doc_id", "text").toArrow())
    return Counter(db.sql(ORACLES["op5_line_dedup"]).fetchall())


def test_lines_by_sql(documents, awkward):
    """All views and the verbatim rule, on texts in which they matter: fields whose values recur, rare templates in a large
    leaf, lines of numbers, leaves with a hot template."""
    rng = random.Random(5)
    names = [f"n{a}" for a in "abcdefghijklmnop"]
    lines = [f"Posted here by {rng.choice(names)} from c{rng.choice(names)} for our readers" for _ in range(900)]
    lines += [f"Posted here by {rng.choice(names)} at the {rng.choice('xyz')} gate today" for _ in range(60)]
    lines += [f"Posted here by anna from {rng.choice(names)} to {rng.choice(names)} on foot" for _ in range(12)]
    lines += [f"{rng.randint(1, 4)}:{rng.randint(1, 4)} 2024-05-0{rng.randint(1, 3)}" for _ in range(40)]
    lines += [f"{rng.randint(1, 9)} of 99 items left {rng.choice(names)}" for _ in range(40)]
    lines += [" ".join(rng.choices(names, k=rng.randint(1, 9))) for _ in range(500)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 3]) for i in range(0, len(lines), 3)]
    texts += texts[:40] + [None, "", "\n\n", "  \t "]
    df = documents(list(enumerate(texts)))
    for table_ in (df, awkward):
        got = line_dedup.clean_lines(table_)
        assert Counter(map(tuple, got.collect())) == by_sql(table_)
    assert line_dedup.clean_lines(df).agg(F.sum("n_dropped")).first()[0] > 500


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li>menu</ul></nav>
<main><article><header><h1>Title &amp; more</h1><p class="byline">by X</p></header><p>One&nbsp;two<br>three <b>bold</b></p>
<ul><li>a<li>b</ul><div class="ad-slot">Buy</div><blockquote>Q</blockquote><table><tr><td>1</td><td>2</td></tr></table>
<p>a < b &#38; c<!-- <p>hidden</p> --><p title="x>y">last</article><section id="comments"><article class="comment">nice
</article></section></main><aside>side</aside><form><label>x</label></form><footer>f</footer></body></html>"""


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, "Title & more\n\nOne two three bold\n\na\n\nb\n\nQ\n\n1 2\n\na < b & c\n\nlast"),
    ("", ""), ("just  text", "just text"), ("<p>cut off <b", "cut off"), ("<article><p>one<p>two &am", "one\n\ntwo &am"),
    ("<body><div role='navigation'>no</div>yes</body>", "yes"), ("<main>m<nav>n</nav></main>rest", "m"),
    ('<div class="layout with-sidebar"><article>one</article></div>', "one"),
    ('<article class="post comments-open">one</article>', "one"),
    ('<div id="content" class="has-nav"><p>one</p></div>', "one"),
    ('<main><div class="widget-text">one</div></main>', "one"),
    ('<article><p>a</p><section id="social-impact"><p>one</p></section></article>', "a\n\none"),
    ('<article><p>a</p><p class="share-price">one</p></article>', "a\n\none"),
    # What is named like a box but holds the article, or most of its text.
    ('<div class="sidebar"><article>one</article></div>', "one"), ('<article class="comment">one</article>', "one"),
    ('<div class="widget"><p>the whole story</p></div><p>x</p>', "the whole story\n\nx"),
    ('<div class="sidebar"><article>teaser</article></div><article>one</article>', "one"),
    ('<article><p>one</p><div id="comments">first! and a lot more of it</div></article>', "one"),
    ('<body><p>one two three</p><div class="cookie-notice">ok?</div><div id="siteFooter">f</div></body>', "one two three"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<script>never closed <p>x</p>", ""), ("<>< a", "<>< a"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_template_of_few_pages_of_a_large_host(spark):
    """A box on 2 % of a host's pages is a template, without a telling name and within an article too."""
    rows = []
    for i in range(300):
        box = f"<div class=q{i % 50}>Visit shop {i % 50}</div>"
        own = f"<p>story {i}</p>"
        rows.append((i, "http://a.example/", f"<article>{own}{box}</article>" if i % 4 < 2 else f"<body>{own}{box}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df).collect()}
    assert got == {i: f"story {i}" for i in range(300)}


def test_hinted_names_inside_an_article_need_recurrence(spark):
    """A paragraph whose name hints at a template goes where it recurs and stays where it does not."""
    rows = [(i, "http://a.example/", f"<article><p>story {i}</p><p class='share-hint'>Tell your friends</p>"
                                     f"<p class='share-price'>{i} euro</p></article>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df).collect()}
    assert got == {i: f"story {i}\n\n{i} euro" for i in range(6)}


def test_very_long_and_null_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} of many</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a.example/", long), (2, "http://a.example/", None), (3, None, "x" * 500_000), (None, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(df).collect()}
    assert got[1].count("\n\n") == 19_999 and got[2] == "" and got[3] == "x" * 500_000 and got[None] == ""


def test_pages(spark):
    """Boxes that only recur are deleted by the count; the article's own recurring paragraph stays."""
    def page(i, box):
        return (f"<body><div class=q7>Visit our shop {box}</div><p>story {i} begins</p><p>story {i} goes on</p>"
                f"<div><span>Follow us</span></div></body>")

    rows = [(i, "http://A.example/x", page(i, "today")) for i in range(8)]
    rows += [(10 + i, f"http://b{i}.example/", page(i, "today")) for i in range(8)]
    rows += [(30 + i, "http://c.example/", f"<article><p>own {i}</p><p>License</p><div>box</div></article>") for i in range(6)]
    rows += [(40, None, None), (41, "http://a.example", ""), (None, "nonsense", "<p>x"), (40, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page", F.lit(1))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_main_text(df).collect())
    expected = Counter()
    for i in range(8):
        story = f"story {i} begins\n\nstory {i} goes on"
        full = f"Visit our shop today\n\n{story}\n\nFollow us"
        expected[i, story, len(story)] += 1
        expected[10 + i, full, len(full)] += 1
    for i in range(6):
        expected[30 + i, f"own {i}\n\nLicense", len(f"own {i}\n\nLicense")] += 1
    expected[40, "", 0] += 2
    expected[41, "", 0] += 1
    expected[None, "x", 1] += 1
    assert got == expected
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_pages_query_is_the_article(spark):
    """The given pages hold one article each, whose blocks are its paragraphs and heading."""
    rows = {r["page_id"]: r for r in QUERIES["op9_html_extraction"](spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert rows[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
