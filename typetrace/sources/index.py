"""Template index as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_index(index: DataFrame, path: str) -> None:
    """Parquet sorted by character, so a character filter skips row groups.

    Spark sizes the files: rows of a character come together, a hot character is split, small ones
    share a file.
    """
    (index.hint("rebalance", "char").sortWithinPartitions("char", "font_id")
     .write.mode("overwrite").parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Fails when the index does not exist; an empty index is never assumed."""
    return spark.read.parquet(path)
