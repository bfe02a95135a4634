"""Sums, counts, shares and ranked contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lead_rank, percent


def _sum(measure: str) -> Column:
    return F.coalesce(F.sum(measure), F.lit(0))


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a missing key."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def sum_by(df: DataFrame, keys: list[str], measure: str = "mentions") -> DataFrame:
    """Sum per key; rows with a missing key are left out and an all-missing group sums to 0."""
    return known(df, *keys).groupBy(*keys).agg(_sum(measure).alias(measure))


def count_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, rows with a missing key left out."""
    return known(df, *keys).groupBy(*keys).agg(F.count("*").alias("n"))


def total(df: DataFrame, measure: str = "mentions") -> DataFrame:
    return df.agg(_sum(measure).alias(measure))


def top_keys(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """The k keys with the largest sums; equal sums in ascending key order."""
    return sum_by(df, [key], measure).orderBy(F.desc(measure), key).limit(k)


def category_share(df: DataFrame) -> DataFrame:
    """Share of every category in all mentions.

    Rows without a category count in the denominator only. They stay in the
    grouping under a NULL key, so the total is taken from the grouped rows and
    the table is read once: ``n_known`` keeps the plans of both uses equal.
    """
    grouped = df.groupBy("category").agg(_sum("mentions").alias("mentions"), F.count("category").alias("n_known"))
    whole = grouped.agg(F.sum(F.when(F.col("n_known") >= 0, F.col("mentions"))).alias("whole")).scalar()
    shares = grouped.filter("n_known > 0").select("category", "mentions", percent(F.col("mentions"), whole).alias("share"))
    return shares.orderBy(F.desc_nulls_last("share"), "category")


def group_category_share(df: DataFrame) -> DataFrame:
    """Share of every category in its group's mentions."""
    sums = sum_by(df, ["grp", "category"])
    in_group = F.sum("mentions").over(Window.partitionBy("grp"))
    return sums.withColumn("share", percent(F.col("mentions"), in_group))


def entity_row_share(df: DataFrame) -> DataFrame:
    """Share of every row in its entity's mentions; no share for a missing entity."""
    sums = known(df, "entity").groupBy("entity").agg(_sum("mentions").alias("entity_mentions"))
    joined = df.join(sums, "entity", "left")
    return joined.withColumn("share", percent(F.col("mentions"), F.col("entity_mentions"))).drop("entity_mentions")


def rank_label(ranked: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``"{rank} - {name}"`` with a rank from 0, on a table cut to a report's top k rows."""
    numbered = ranked.withColumn("rank", lead_rank(*order) - 1)
    return numbered.withColumn("label", F.concat_ws(" - ", F.col("rank").cast("string"), F.col(name)))


def top_contributors(df: DataFrame, k: int = 10) -> DataFrame:
    """The k entities with most mentions, labelled by rank."""
    best = top_keys(df, "entity", "mentions", k)
    return rank_label(best, "entity", [F.desc("mentions"), F.asc("entity")]).orderBy("rank")


def preview(df: DataFrame, n: int = 10, order: str = "row_id") -> DataFrame:
    """First n rows in input order."""
    return df.orderBy(order).limit(n)
