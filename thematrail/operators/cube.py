"""Stored sums of mentions, from which shares are answered without reading the mentions again.

Every load adds its own sums by (group, entity, category) and by the coarser keys that reports ask for. Sums merge, so a report adds up
the loads' rows of the coarsest level that has the columns it groups and selects by; the operators of :mod:`.shares` take these
rows as they take mentions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .filters import ALL, filter_members

COLUMNS = ("grp", "entity", "category")

#: What sums are kept by. A level's number has a bit for each column of COLUMNS that is summed over, as ``grouping_id`` gives it.
LEVELS = (COLUMNS, ("grp", "category"), ("grp",), ("entity",), ("category",), ())


class ShareCube:
    """Sums in a folder that all executors share; ``kinds`` are the types of COLUMNS."""

    def __init__(self, spark: SparkSession, folder: str, kinds: str = "grp string, entity string, category string"):
        self.spark, self.folder = spark, folder
        self.schema = StructType([*StructType.fromDDL(kinds).fields, StructField("mentions", LongType()), StructField("n", LongType())])

    def load(self, mentions: DataFrame, load_id: str) -> None:
        """Add a table of mentions. The same ``load_id`` again replaces what it had added, so a load that was lost half-way is just repeated.

        Mentions are read once and grouped by all columns; coarser sums are taken of those rows. Null keys are keys, null mentions add
        nothing, an empty table adds none, and other columns are not looked at.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", load_id):
            raise ValueError(f"load_id must be letters, digits, '-' and '_', not {load_id!r}")
        summed = mentions.groupBy(*COLUMNS).agg(F.sum("mentions").cast("bigint").alias("mentions"), F.count("*").alias("n"))
        self._store(summed, load_id)

    def _store(self, summed: DataFrame, load_id: str) -> None:
        sets = [[F.col(c) for c in level] for level in LEVELS]
        levels = summed.groupingSets(sets, *COLUMNS).agg(
            F.sum("mentions").alias("mentions"), F.sum("n").alias("n"), F.grouping_id(*COLUMNS).cast("int").alias("level")
        )
        levels.write.mode("overwrite").partitionBy("level").parquet(f"{self.folder}/load={load_id}")

    def cells(self, keys: Iterable[str] = (), selections: Mapping[str, Iterable] | None = None) -> DataFrame:
        """Rows whose ``mentions`` and ``n`` (rows) add up to those of every combination of ``keys`` among the rows selected (see :func:`.filters.filter_members`)."""
        chosen = {column: list(values) for column, values in (selections or {}).items()}
        needed = {*keys, *(column for column, values in chosen.items() if ALL not in values)}
        if not needed <= set(COLUMNS):
            raise ValueError(f"sums are kept by {COLUMNS} only, not by {sorted(needed - set(COLUMNS))}")
        level = min((held for held in LEVELS if needed <= set(held)), key=len)
        number = int("".join("0" if column in level else "1" for column in COLUMNS), 2)
        schema = StructType([*self.schema.fields]).add("load", "string").add("level", "integer")
        rows = self.spark.read.schema(schema).parquet(self.folder).filter(F.col("level") == number)
        return filter_members(rows.select(*level, "mentions", "n"), {c: v for c, v in chosen.items() if c in level})

    def filter_stats(self, selections: Mapping[str, Iterable] | None = None) -> DataFrame:
        """As :func:`.filters.filter_stats` of the rows selected."""
        counted = self.cells((), selections).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"))
        return counted.withColumn("is_empty", F.col("n_rows") == 0)

    def compacted(self, folder: str) -> ShareCube:
        """A cube in another folder that holds all loads as one."""
        other = ShareCube(self.spark, folder)
        other.schema = self.schema
        merged = self.cells(COLUMNS).groupBy(*COLUMNS).agg(F.sum("mentions").alias("mentions"), F.sum("n").alias("n"))
        other._store(merged, uuid.uuid4().hex)
        return other
