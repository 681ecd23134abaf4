"""Catalogue, manifest and character-set sources, and the coverage report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from typetrace.schemas import FONT


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of font rows, in file order under ``file_pos``."""
    rows = spark.read.schema(FONT).option("multiLine", True).json(path)
    return rows.withColumn("file_pos", F.monotonically_increasing_id())


def parse_catalogue(rows: DataFrame, column: str) -> DataFrame:
    """The same rows when they arrive as one JSON text each."""
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.from_json(column, FONT).alias("f")).select(*keep, "f.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """``(pos, value)`` lines of the form ``id: url``; blanks and ``#`` lines are skipped and a
    later line overwrites an earlier one of the same id."""
    text = F.trim("value")
    entries = lines.filter((text != "") & ~F.startswith(text, F.lit("#"))).select(
        "pos", F.split(text, ": ", 2).alias("e")
    )
    return entries.groupBy(F.get("e", F.lit(0)).alias("font_id")).agg(
        F.max_by(F.get("e", F.lit(1)), "pos").alias("url")
    )


def character_positions(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Ordered characters of each character-set text."""
    return texts.select(key, F.posexplode(F.split(text, "")).alias("char_pos", "char")).filter(F.col("char") != "")


def last_positions(positions: DataFrame, key: str) -> DataFrame:
    """A repeated character is found at its last position."""
    return positions.groupBy(key, "char").agg(F.max("char_pos").alias("char_pos"))


def write_coverage(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
