"""Image files and raw pixel payloads to crop rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as ``origin, height, width, channels, px`` with interleaved channels.

    A file that cannot be decoded stays as a row with an ``error`` and without pixels.
    """
    image = lambda field, name: F.when(~broken, F.col(f"image.{field}")).alias(name)
    broken = F.col("image.height") <= 0
    return spark.read.format("image").option("dropInvalid", False).load(path).select(
        F.col("image.origin").alias("origin"), image("height", "height"), image("width", "width"),
        image("nChannels", "channels"), image("data", "px"),
        F.when(broken, F.lit("not an image")).alias("error"),
    )


def from_base64(payload: Column) -> Column:
    """Raw pixels that arrive as base64 text."""
    return F.unbase64(payload)


def levels(px: Column) -> Column:
    """Binary pixels as an array of levels 0 to 255."""
    hexed = F.hex(px)
    at = F.sequence(F.lit(0), F.octet_length(px) - 1)
    return F.when(F.octet_length(px) > 0, F.transform(
        at, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
