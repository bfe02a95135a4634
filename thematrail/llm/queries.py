"""Registered queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import digest_documents
from .centroids import cluster_vectors
from .collisions import near_vectors
from .conversations import damaged, repair_conversations
from .density import extract_text
from .exact import exact_dedup
from .fixity import archive_index, audit
from .language import identify_documents
from .licences import scan_licences
from .mixing import mix_sources
from .pieces import digest_pieces
from .setsketch import near_duplicates
from .shards import shard_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op3_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def op4_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica holds the pages but for damage by page id: a changed last byte, a cut end, or no record."""
    html, n = F.col("html"), F.pmod(F.col("page_id"), F.lit(211))
    damaged = F.when(n == 17, F.concat(F.substring(html, 1, F.greatest(F.length(html) - 1, F.lit(0))), F.lit("\u0001")))
    damaged = damaged.when(n == 101, F.substring(html, 1, F.floor(F.length(html) / 2).cast("int"))).when(n == 202, F.lit(None)).otherwise(html)
    return audit(archive_index(_table(spark, sf_dir, "pages"), damaged))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), 16)


def op9_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = identify_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))
    return judged.select("doc_id", "identified", "confidence", F.col("accepted").alias("kept"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vantage_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(turns), turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_collision_counts, op2_text_density, op3_licence_digests, op4_digest_index, op5_merkle_audit, op6_bpe_transducer, op7_setsketch, op8_jump_shards, op9_evidence_fusion, op10_source_mix, op11_offset_pieces, op12_vantage_centroids, op13_grammar_repair)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
