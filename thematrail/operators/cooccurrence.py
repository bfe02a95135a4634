"""Strongest categories of each entity and the graph between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent
from .filters import keep_keys
from .shares import known, sum_by, top_keys


def top_rows_per_entity(df: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of each entity with the largest share in it.

    Rows, not categories, are ranked: several rows of one category each take a
    place. Ties go by category, then row_id; rows without a share come last.

    Counts are never negative, so inside an entity the order by share is the
    order by count, unless all of them are 0 or missing. Taking k counted and k
    uncounted rows per entity therefore holds the answer in both cases. That cut
    is pushed before the shuffle (a window group limit), so even an entity with
    a third of all rows sends at most 2k rows per input task; the sums are
    combined before their shuffle too. Shares are worked out on the few rows left.
    """
    rows = known(df, "entity").select("entity", "category", "row_id", "mentions")
    uncounted = F.col("mentions").isNull().alias("uncounted")
    by_count = Window.partitionBy("entity", "uncounted").orderBy(F.desc("mentions"), "category", "row_id")
    candidates = rows.select("*", uncounted).withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= k)
    sums = sum_by(rows, ["entity"]).withColumnRenamed("mentions", "entity_mentions")
    shares = candidates.join(sums, "entity").select(
        "entity", "category", "row_id", "mentions",
        percent(F.col("mentions"), F.col("entity_mentions")).alias("share"),
    )
    # row_id settles every tie; "mentions" behind it only keeps the shuffled columns
    # the same for all uses of this table, so that they share one shuffle.
    by_share = Window.partitionBy("entity").orderBy(F.desc_nulls_last("share"), "category", "row_id", "mentions")
    return shares.withColumn("place", F.row_number().over(by_share)).filter(F.col("place") <= k)


def global_top_categories(df: DataFrame, k_entity: int = 5, k_global: int = 5) -> DataFrame:
    """The categories with the largest share in the entities' top rows."""
    top_rows = top_rows_per_entity(df, k_entity)
    whole = top_rows.agg(F.sum("mentions").alias("whole")).scalar()
    return top_keys(top_rows, "category", "mentions", k_global).withColumn("share", percent(F.col("mentions"), whole))


def items_by(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Sorted distinct items per key, for rows already cut to a few per key."""
    return known(rows, key, item).groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))


def pairs_within(items: DataFrame) -> DataFrame:
    """Pairs ``a < b`` out of each row's sorted item list (at most k items, so k(k-1)/2 pairs)."""
    rest = lambda i: F.slice(F.col("items"), i + 2, F.size("items"))
    pairs = F.flatten(F.transform("items", lambda a, i: F.transform(rest(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return items.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b")


def cooccurrence(df: DataFrame, k_entity: int = 5, k_global: int = 5) -> DataFrame:
    """Edges between the leading categories: entities that hold both, and the share in all such pairs.

    Only k_global categories remain, so the last window sees at most
    k_global (k_global - 1) / 2 rows. No pair gives an empty table.
    """
    top_rows = top_rows_per_entity(df, k_entity)
    kept = keep_keys(top_rows, top_keys(top_rows, "category", "mentions", k_global), "category")
    counted = pairs_within(items_by(kept, "entity", "category")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return counted.withColumn("weight", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def graph_nodes(top: DataFrame, edges: DataFrame) -> DataFrame:
    """Leading categories and edge ends, isolated ones included."""
    return top.select("category").union(edges.select("a")).union(edges.select("b")).distinct()


def graph_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at each node and the marker size drawn from it (5 per edge); 0 if isolated."""
    ends = edges.select(F.col("a").alias("category")).union(edges.select(F.col("b").alias("category")))
    degrees = ends.groupBy("category").agg(F.count("*").alias("degree"))
    joined = nodes.join(degrees, "category", "left")
    return joined.select("category", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("marker_size", F.col("degree") * 5)
