"""Institution names held one per row or as a comma-delimited list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import delimited_items, percent
from .filters import keep_keys
from .shares import count_by, rank_label, top_keys


def explode_names(df: DataFrame, column: str = "names") -> DataFrame:
    """One row per name of a list; missing lists and empty items give none."""
    exploded = df.withColumn("name", F.explode(delimited_items(F.col(column)))).drop(column)
    return exploded.filter(F.length("name") > 0)


def name_share(names: DataFrame, k: int = 10) -> DataFrame:
    """The k names found most often, with their share among all names."""
    counts = count_by(names, ["name"])
    whole = counts.agg(F.sum("n").alias("whole")).scalar()
    best = top_keys(counts, "name", "n", k).withColumn("share", percent(F.col("n"), whole))
    return rank_label(best, "name", [F.desc("n"), F.asc("name")]).orderBy("rank")


def name_group_share(names: DataFrame, k: int = 10) -> DataFrame:
    """Share of the k leading names inside each group; the other names are not in the denominator."""
    counts = count_by(names, ["name", "grp"])
    kept = keep_keys(counts, top_keys(counts, "name", "n", k), "name")
    shares = kept.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy("grp"))))
    return shares.orderBy(F.desc("share"), "grp", "name")
