"""A corpus pipeline of five stages, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thematrail.llm.bpe import encode_documents
from thematrail.llm.exact import without_copies
from thematrail.llm.language import in_known_language
from thematrail.llm.mixing import mixed_documents
from thematrail.llm.setsketch import without_near_copies
from thematrail.llm.store import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the others go."""
    return in_known_language(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest doc_id."""
    return without_near_copies(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document is repeated as often as it is taken."""
    return mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, the text decoded from them and its digest."""
    encoded = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=40_000)
    return encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokenize", tokenize)]

#: SQL cannot express the fitted language model nor the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
