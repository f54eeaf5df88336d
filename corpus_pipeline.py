"""Training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. Its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import bpe, exact_dedup, mixing, quality, simhash
from tabloom.llm.common import write_down
from tabloom.llm.queries import MIX, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, does not reject."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest id."""
    return simhash.keep_one_of_each(docs, words_each=3, distance=3)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages in the shares of ``MIX``: documents of rarer ones repeat, none is left out."""
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return mixing.mix(docs, known.selectExpr("doc_id", "lang AS domain"), MIX)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of what they decode to."""
    trip = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return trip.selectExpr("doc_id", "n_tokens", "ids", "sha2(ids, 256) AS ids_sha256",
                           "sha2(decoded, 256) AS decoded_sha256")


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", dissimilar_documents),
    ("mixing to target weights", mixed_documents),
    ("byte-level BPE", encoded_documents),
]

#: Neither the fitted models nor SimHash and BPE can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``: ``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` per training document,
    one row for each copy that the mixing asks for.

    Null and empty texts are rejected by the first stage; an empty table gives an empty result. Rows that repeat in id and
    text count as copies, of which one stays. Other columns pass through the stages, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_down(stage(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)
