"""Tables written to the folder that all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from thematrail.session import shared_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every call gives another one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps then read the same rows however often they run and whichever
    executor is lost. The files stay until the shared folder is cleared.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
