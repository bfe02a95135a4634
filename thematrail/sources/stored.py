from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

PAGE_SCHEMA = (
    "page_id bigint, page_number int, entity string, grp string, link string, text string, embedding array<float>"
)


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page vectors with their text and metadata, as Parquet in the canonical schema."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def cached(df: DataFrame) -> DataFrame:
    """``df`` kept for use by several reports; what does not fit in memory goes to executor disks."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
