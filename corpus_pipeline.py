"""A corpus pipeline: each stage works on all documents that the one before kept.

Stages, in order: documents without a main language go, one document of each SimHash group stays, windows that an earlier
document has are cut out, documents that hold a benchmark item go, and the rest is encoded by byte-level BPE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerglass.llm import bpe, langid, simhash, superkmers, templates
from ledgerglass.llm.common import crc_mod, fresh, settle, table
from ledgerglass.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The share of a document's words that one language must have.
MAIN_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay in which one language of the inferred mixture has MAIN_SHARE of the words.

    Null texts and texts without a letter have no language and go, ids or not. Ties between languages do not matter here:
    a share of one half is enough. Rows without an id or a language are judged, but not learnt from; repeats are judged alike.
    """
    name = fresh(docs, "language")
    found = langid.predict(docs, crc_mod("doc_id", 4) != 2, keep=name)
    return found.where((F.col(name)["languages"] > 0) & (F.col(name)["score"] >= MAIN_SHARE)).select(*[found[f"`{c}`"] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id: fingerprints within two bits, or sets of 5-word shingles 0.8 alike.

    Null and empty texts are one group. Rows without an id stay; rows that repeat id and text become one.
    """
    return simhash.keep_one(docs, words_per_shingle=5, similarity=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that lie in a window of 50 words of a document with a smaller id are cut out; every row stays.

    Null, empty and short texts stay as they are, as do rows without an id; rows that repeat an id never shorten each other.
    """
    return superkmers.remove(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark`, re-parameterised or not, go; rows that repeat such an id go with it.

    Null and empty texts hold nothing. Rows without an id stay.
    """
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: its tokens, the digest of its ids and of what they decode to; null text is empty."""
    from public_tokenizers import PATTERN

    return bpe.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The stages of language models, vantage-point trees and byte-pair merges have no SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
