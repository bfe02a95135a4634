"""The canonical tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words

# Terms that occur in the given (invented) prose.
THEMES = {
    "theme 1": ["thatin", "ononst", "of the", "and. the", "the\nand"],
    "theme 2": ["orantion", "inoran", "with and"],
    "theme 3": ["nicht", "enlich", "die und"],
    "theme 4": ["ément", "éelle", "ciónue"],
}
AREAS = {
    "area 1": ["hehely", "thing", "in the"],
    "area 2": ["thble", "erble", "enheit", "etion des"],
}
NAMES = [
    "Thing", "Thatin", "Ononst", "Inoran", "Hehely", "Orantion", "Nicht", "Enlich",
    "Of the", "And the", "With and", "Die und", "Ément", "Ciónue", "Thble",
]
SYSTEM_TEXT = "Answer from these passages only:\n\n{context}\n\nSay so if they hold no answer.\n"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _owners(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("entity"), F.col("c_mktsegment").alias("grp"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("row_id", "entity", "grp")


def _lines(spark: SparkSession, folder: str, part_column: str, alias: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", F.col(part_column).alias(alias))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_partkey", "l_quantity")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("row_id", alias, "l_quantity")


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity per order and brand; summed before it meets the orders, so a huge order is small by then."""
    summed = _lines(spark, folder, "p_brand", "category").groupBy("row_id", "category").agg(
        F.sum("l_quantity").cast("bigint").alias("mentions")
    )
    return summed.join(_owners(spark, folder), "row_id").select("row_id", "entity", "grp", "category", "mentions")


def name_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct part names of each order, as one list. The names come from a vocabulary of 64."""
    distinct = _lines(spark, folder, "p_name", "name").select("row_id", "name").distinct()
    lists = distinct.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return lists.join(_owners(spark, folder), "row_id").select("row_id", "entity", "grp", "names")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.col("source").alias("entity"), F.col("lang").alias("grp"), "text")


def opening_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon that grows with the documents: the first two words of every document, by its source."""
    opening = F.array_join(F.slice(words(F.col("text")), 1, 2), " ")
    return table(spark, folder, "documents").select(F.col("source").alias("category"), opening.alias("term"))


def benchmark_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names from a table: the first three words of every benchmark passage."""
    return table(spark, folder, "benchmark").select(F.array_join(F.slice(words(F.col("text")), 1, 3), " ").alias("name")).distinct()


def theme_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("entity"), F.col("lang").alias("grp"),
        F.col("source").alias("category"), F.col("n_chars").alias("mentions"), F.col("text").alias("summary"),
    )


def roles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("entity"), F.col("lang").alias("grp"), F.col("text").alias("role_summary")
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector, with the group and entity of its document."""
    found = table(spark, folder, "documents").select("doc_id", F.col("source").alias("entity"), F.col("lang").alias("grp"))
    pages = table(spark, folder, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
    return pages.join(found, F.col("page_id") == F.col("doc_id"), "left").drop("doc_id")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), (F.col("doc_id") % 9 + 1).cast("int").alias("page_number"), F.col("source").alias("entity"),
        F.col("lang").alias("grp"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("link"), "text",
    )


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One question vector per label: the mean of the label's vectors."""
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells"))
    return rows.select(F.col("label").cast("bigint").alias("query_id"), F.transform("cells", lambda c: c["v"]).alias("embedding"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def conversation_queries(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for every question, picked among all by conversation and turn."""
    found = table(spark, folder, "embeddings")
    picked = F.pmod(F.col("conv_id") * 7 + F.col("turn"), found.agg(F.count("*")).scalar())
    asked = turns(spark, folder).filter("role = 'user'").select("conv_id", "turn", picked.alias("vec_id"))
    return asked.join(found.select("vec_id", "embedding"), "vec_id").drop("vec_id")
