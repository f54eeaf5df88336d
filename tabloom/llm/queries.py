"""One query per operator over its whole table, with the parameters meant for production, and SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    exact_dedup,
    html_text,
    line_dedup,
    mixing,
    order_minhash,
    packing,
    quality,
    search,
    sharding,
    simhash,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words_each=3, distance=3)


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    trip = bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
    return bpe.digests(trip)


@query
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs))
    return scored.select("doc_id", "quality_score", "weak_label", (F.col("quality_score") >= 0.5).alias("kept"))


#: Languages and the shares of expected tokens that training is to see of them.
MIX = {"en": 0.55, "fr": 0.17, "de": 0.16, "es": 0.12}


def labelled_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language as the domain of the labelled documents; the classifier carries it over to all others."""
    known = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("domain"))
    return known.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")


@query
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mixing_rates(docs, labelled_languages(spark, folder), MIX).drop("raw")


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, folder, "documents"), shards=8)


@query
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.collapse_conversations(table(spark, folder, "conversations"))


ORACLES["op8_chat_formatting"] = """
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
pieces AS (
  SELECT *, coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce(length(text)::VARCHAR || ':' || text, '-')
    AS whole,
    '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '<| im_') || chr(10)
    || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS piece
  FROM placed),
so_far AS (
  SELECT conv_id, pos, n, string_agg(whole, '') OVER w AS whole, string_agg(piece, '') OVER w AS chat
  FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ends AS (
  SELECT n, whole, min(conv_id) AS conv_id, count(*) AS copies, any_value(chat) AS chat
  FROM so_far WHERE pos = n GROUP BY n, whole)
SELECT conv_id, n AS n_turns, copies, chat FROM ends
WHERE NOT EXISTS (SELECT 1 FROM so_far s WHERE s.pos < s.n AND s.pos = ends.n AND s.whole = ends.whole)
"""


@query
def op6_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edited_neighbours(table(spark, folder, "documents"))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.clean_lines(table(spark, folder, "documents"))


ORACLES["op5_line_dedup"] = r"""
WITH shares AS (SELECT unnest([0.0, 0.001, 0.01, 0.1, 0.5]::DOUBLE[]) AS share),
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
split AS (SELECT t, string_split(t, chr(10)) AS parts FROM texts),
numbered AS (SELECT t, unnest(range(len(parts))) AS line, unnest(parts) AS own FROM split),
worded AS (SELECT t, line, [w FOR w IN regexp_split_to_array(own, '[ \t\x0B\f\r]+') IF w <> ''] AS own FROM numbered),
masked AS (
  SELECT t, line, own, [CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END FOR w IN own] AS words,
    len([w FOR w IN own IF NOT regexp_matches(w, '[0-9]')]) AS fixed
  FROM worded WHERE len(own) > 0),
parsed AS (
  SELECT t, line, words, len(words) AS n, words[1:3] AS lead, fixed, fixed >= 0.5 * len(words) AS telling,
    CASE WHEN fixed >= 0.5 * len(words) THEN words ELSE list_prepend('<own>', own) END AS whole FROM masked),
whole AS (SELECT whole FROM parsed GROUP BY whole HAVING count(DISTINCT t) >= 3),
rest AS (SELECT * FROM parsed r WHERE telling AND n > 3 AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.whole = r.whole)),
leaves AS (SELECT n, lead, count(*) AS lines FROM rest GROUP BY n, lead HAVING count(DISTINCT t) >= 3),
shared AS (
  SELECT r.*, len([w FOR w IN r.lead IF w <> '<*>']) AS led FROM rest r JOIN leaves l ON r.n = l.n AND r.lead = l.lead),
spots AS (SELECT t, line, n, lead, unnest(range(4, n + 1)) AS at_, unnest(words[4:]) AS word FROM shared),
counted AS (
  SELECT n, lead, at_, word, count(*) AS c FROM spots WHERE word <> '<*>' GROUP BY n, lead, at_, word HAVING count(*) >= 3),
constants AS (
  SELECT c.n, c.lead, at_, word, share FROM counted c JOIN leaves l ON c.n = l.n AND c.lead = l.lead, shares
  WHERE c.c >= share * l.lines),
held AS (
  SELECT s.t, s.line, share, count(*) AS held, string_agg(s.at_::VARCHAR || ':' || s.word, ' ' ORDER BY s.at_) AS form
  FROM spots s JOIN constants c ON s.n = c.n AND s.lead = c.lead AND s.at_ = c.at_ AND s.word = c.word
  GROUP BY s.t, s.line, share),
templates AS (
  SELECT DISTINCT s.t, s.line, s.n, s.lead, coalesce(form, '') AS form
  FROM (SELECT * FROM shared, shares) s LEFT JOIN held h ON s.t = h.t AND s.line = h.line AND s.share = h.share
  WHERE s.led + coalesce(held, 0) >= 0.5 * s.n),
general AS (SELECT n, lead, form FROM templates GROUP BY n, lead, form HAVING count(DISTINCT t) >= 3),
gone AS (
  SELECT t, line FROM parsed x WHERE EXISTS (SELECT 1 FROM whole w WHERE w.whole = x.whole)
  UNION
  SELECT x.t, x.line FROM templates x JOIN general g ON x.n = g.n AND x.lead = g.lead AND x.form = g.form),
per_text AS (SELECT t, list(line) AS gone FROM gone GROUP BY t)
SELECT doc_id, len(parts)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_dropped,
  CASE WHEN gone IS NULL THEN s.t
  ELSE coalesce(array_to_string([parts[i + 1] FOR i IN range(len(parts)) IF NOT list_contains(gone, i)], chr(10)), '')
  END AS text
FROM documents d JOIN split s ON coalesce(d.text, '') = s.t LEFT JOIN per_text p ON s.t = p.t
"""


@query
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"))


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    own = whitening.whiten(table(spark, folder, "embeddings"), components=16, weights="one")
    return own.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN, capacity=1024, end=2)
    return packed.drop("ids")


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), most=10)


ORACLES["op13_lexical_search"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS row
  FROM documents),
asked AS (
  SELECT item_id, row, term, count(*) AS repeats FROM (
    SELECT item_id, row_number() OVER () AS row, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
whole AS (SELECT count(*) AS nn, sum(len(terms))::BIGINT AS ll FROM words WHERE len(terms) > 0),
postings AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (
    SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM words) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, nn),
scores AS (
  SELECT a.row, a.item_id, p.row AS doc, p.doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM asked a JOIN postings p ON a.term = p.term JOIN weights w ON w.term = p.term, whole
  GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
