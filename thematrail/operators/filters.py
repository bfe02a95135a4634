"""Selections, value domains and gates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import delimited_items

# Fixed value: the choice that switches a filter off.
ALL = "All"


def filter_members(df: DataFrame, selections: Mapping[str, Iterable]) -> DataFrame:
    """Keep rows whose value is selected in every column.

    ``All`` anywhere in a selection switches that column off; an empty selection
    keeps no row.
    """
    for column, chosen in selections.items():
        values = list(chosen)
        if ALL not in values:
            df = df.filter(F.col(column).isin(values) if values else F.lit(False))
    return df


def metadata_filter(entities: Iterable = (ALL,), groups: Iterable = (ALL,)) -> Column | None:
    """Page filter for retrieval, or None for no filter.

    Unlike :func:`filter_members` an empty selection means no filter, and a
    selection of groups takes the place of one of entities.
    """
    for column, chosen in (("grp", list(groups)), ("entity", list(entities))):
        if chosen and ALL not in chosen:
            return F.col(column).isin(chosen)
    return None


def filter_name_list(df: DataFrame, column: str, chosen: Iterable[str]) -> DataFrame:
    """Keep rows whose comma-delimited list holds one of the chosen names."""
    names = list(chosen)
    if ALL in names:
        return df
    if not names:
        return df.filter(F.lit(False))
    overlap = F.arrays_overlap(delimited_items(F.col(column)), F.array(*[F.lit(n) for n in names]))
    return df.filter(F.coalesce(overlap, F.lit(False)))


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys``: a top-k table, so at most k rows are broadcast."""
    return df.join(F.broadcast(keys.select(on)), on, "left_semi")


def domain_values(df: DataFrame, column: str) -> DataFrame:
    """Choices of a filter: ``All`` (ord 0) before the distinct values (ord 1), ascending."""
    values = df.filter(F.col(column).isNotNull()).select(column).distinct()
    listed = values.select(F.lit(1).alias("ord"), F.col(column).alias("sort_key"))
    first = df.sparkSession.range(1).select(
        F.lit(0).alias("ord"), F.lit(None).cast(values.schema[0].dataType).alias("sort_key")
    )
    text = F.coalesce(F.col("sort_key").cast("string"), F.lit(ALL)).alias("value")
    return first.union(listed).orderBy("ord", "sort_key").select("ord", text)


def filter_stats(df: DataFrame) -> DataFrame:
    """Row count after filtering, and whether nothing is left."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("is_empty", F.col("n_rows") == 0)


def gate_min_distinct(df: DataFrame, column: str, more_than: int = 1, source: DataFrame | None = None) -> DataFrame:
    """``df`` if ``column`` of ``source`` has over ``more_than`` distinct values, else no rows.

    NULL counts as a value. Only ``more_than + 1`` distinct values are counted.
    """
    seen = (df if source is None else source).select(column).distinct().limit(more_than + 1)
    return df.filter(seen.agg(F.count("*").alias("n")).scalar() > more_than)
