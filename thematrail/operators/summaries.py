"""Extractive map and reduce summaries.

The map step picks, per category, the sentences with most of the category's key
terms; the reduce step does the same once more over the picked texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bound, sentences, words
from ..sources import cached
from .shares import known

#: A key term is a word found in at least one of so many texts of its category.
ONE_IN = 20

#: Bytes of key terms up to which they are sent to the tasks.
TERM_BYTES = 64 << 20


def key_terms(df: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The words, of any length, found in at least one of ``one_in`` texts of a category: category, term, n_texts.

    There are at most ``one_in`` times as many as a text of the category has words on average.
    """
    rows = known(df, "category", "summary").select("category", "row_id", "summary")
    sizes = rows.groupBy("category").agg(F.count("*").alias("n"))
    found = rows.select("category", F.explode(F.array_distinct(words(F.col("summary")))).alias("term"))
    counted = found.groupBy("category", "term").agg(F.count("*").alias("n_texts"))
    return counted.join(sizes, "category").filter(F.col("n_texts") * one_in >= F.col("n")).drop("n")


def summarize_map(df: DataFrame, n: int = 3, one_in: int = ONE_IN) -> DataFrame:
    """The n best sentences of every category in reading order: ``category, summary``.

    A sentence scores the number of different key terms in it; ties go to the
    earlier one, and copies of a sentence count once. Key terms are worked out first; up to ``TERM_BYTES`` they are sent to the texts,
    which then stay in place. Sentences are scored inside their row, and a row passes on only its own n best (no other can be among
    the category's n best).
    """
    rows = known(df, "category", "summary").select("category", "row_id", "summary")
    terms = cached(key_terms(rows, one_in).groupBy("category").agg(F.collect_list("term").alias("terms")))
    size = terms.agg(F.sum(F.length(F.array_join("terms", "  ")))).first()[0] or 0
    if size <= TERM_BYTES:
        terms = F.broadcast(terms)
    own_terms = F.array_intersect(words(F.col("summary")), F.coalesce("terms", F.array().cast("array<string>")))
    best = F.slice(F.array_sort(bound(own_terms, lambda own: F.transform(
        F.array_distinct(sentences(F.col("summary"))),
        lambda s, i: F.struct((-F.size(F.array_intersect(words(s), own))).alias("minus"), i.alias("at"), s.alias("sentence")),
    ))), 1, n)
    scored_rows = rows.join(terms, "category", "left")
    passed = scored_rows.select("category", "row_id", F.explode(best).alias("s"))
    position = F.struct("row_id", F.col("s.at").alias("at"))
    single = passed.groupBy("category", F.col("s.minus").alias("minus"), F.col("s.sentence").alias("sentence")).agg(F.min(position).alias("position"))
    place = Window.partitionBy("category").orderBy("minus", "position")
    chosen = single.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)
    lines = F.array_sort(F.collect_list(F.struct("position", "sentence")))
    return chosen.groupBy("category").agg(lines.alias("lines")).select(
        "category", F.array_join(F.transform("lines", lambda r: r["sentence"]), " ").alias("summary")
    )


def summarize_reduce(texts: DataFrame, n: int = 3, order: str = "category", text: str = "summary", one_in: int = ONE_IN) -> DataFrame:
    """One summary over all texts, read in the given order."""
    whole = texts.select(F.lit("").alias("category"), F.col(order).alias("row_id"), F.col(text).alias("summary"))
    return summarize_map(whole, n, one_in).select("summary")
