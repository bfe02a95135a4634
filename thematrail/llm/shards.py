"""Sharding by jump consistent hashing: no ring table, and an added shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the multiplier of the 64-bit generator in the published jump hash.
MULTIPLIER = 2862933555777941757

#: Rows that are numbered together in one group of the slot window, on average.
BLOCK_ROWS = 100_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; with one more shard a key stays or moves to the new one."""
    state = keys.astype(np.uint64)
    shard, target = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    while (moving := target < shards).any():
        shard = np.where(moving, target, shard)
        state = np.where(moving, state * np.uint64(MULTIPLIER) + np.uint64(1), state)
        step = float(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target = np.where(moving, ((shard + 1) * step).astype(np.int64), target)
    return shard.astype(np.int32)


def shard_column(key: Column, shards: int) -> Column:
    """Jump hash of a bigint column that holds no null."""

    @F.pandas_udf("int")
    def assigned(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards))

    return assigned(key)


def stable_key(df: DataFrame, column: str) -> Column:
    """Whole numbers are their own key, other types are hashed; null counts as 0."""
    whole = dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(column).cast("bigint") if whole else F.xxhash64(column), F.lit(0).cast("bigint"))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign every row to a shard by its key alone.

    Columns: the key, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot
    (gapless from 0 within the shard), grown_shard (the shard if there were one more).
    A null text has size 1 and the CRC of the empty text; rows with a null key go where
    key 0 goes. Repeated rows each get a slot of their own. Other columns are left out,
    an empty table gives none.

    Rows alike in all these columns are counted first and become rows again at the end, in runs
    of at most ``block_rows``, so neither a repeated key nor a repeated row is one group. Slots are
    numbered in blocks whose number grows with the table: counts per block are summed up to
    offsets, so no shard is ever sorted as one group.
    """
    counted = docs.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block_rows))).cast("bigint")).scalar()
    octets = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key), stable_key(docs, key).alias("stable"), (F.octet_length(octets).cast("bigint") + 1).alias("size"), F.crc32(octets).alias("text_crc32"),
    )
    alike = [key, "stable", "size", "text_crc32"]
    kinds = rows.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.withColumn("shard", shard_column(F.col("stable"), shards)).withColumn("grown_shard", shard_column(F.col("stable"), shards + 1))
    kinds = kinds.withColumn("block", F.pmod(F.xxhash64("stable", "size", "text_crc32"), counted))
    sizes = kinds.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("stable", "size", "text_crc32", F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.join(offsets, ["shard", "block"]).withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.select(key, "size", "text_crc32", "shard", "grown_shard", "start", "n")
    # many rows alike: their runs are dealt out before they become rows
    runs = placed.filter(F.col("n") > block_rows).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {int(block_rows)}"))).alias("run"))
    runs = runs.select(
        key, "size", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("run") * block_rows).alias("start"),
        F.least(F.col("n") - F.col("run") * block_rows, F.lit(block_rows)).alias("n"),
    )
    placed = placed.filter(F.col("n") <= block_rows).unionByName(runs.repartition("shard", "start"))
    return placed.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("slot"), "grown_shard",
    )
