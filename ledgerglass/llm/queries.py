"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, matroska, quality, repair, simhash, superkmers, templates, toxicity, transcripts
from .common import crc_mod, settle, table


def vocabulary(name: str) -> str:
    """A public vocabulary's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(n: int, k: int):
    """Whether an id is kept from learning; a null id has no remainder, is not learnt from and counts as not held out."""
    return F.coalesce(crc_mod("doc_id", n) == k, F.lit(False)).alias("held_out")


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1))


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return found.select("doc_id", held_out(5, 0), "score", "predicted", "spans")


def op3_simhash_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op5_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = settle(transcripts.logs(table(spark, sf_dir, "conversations")), "transcripts")
    found = transcripts.parse(raw, transcripts.fit(raw))
    return found.select("conv_id", "n_turns", F.array_join("roles", ",").alias("roles"), F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("bigint").alias("rendered_chars"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return found.select("doc_id", held_out(3, 1), "score", "predicted")


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.digests(table(spark, sf_dir, "documents"))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict(table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) != 2)
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score", "languages", "proportions")


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_repair_token_ids, op2_toxic_spans, op3_simhash_vantage_points, op4_byte_bpe, op5_transcript_roles, op6_template_decontamination, op7_pairwise_quality, op8_super_kmers, op9_language_mixture, op10_matroska)}
ORACLE_SQL: dict[str, str] = {"op6_template_decontamination": templates.sql(), "op8_super_kmers": superkmers.sql()}
