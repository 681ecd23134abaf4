"""OCR lines as an input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def complete_lines(lines: DataFrame) -> DataFrame:
    """Rows whose box, every point of it, text and score are present."""
    return lines.filter(
        F.col("box").isNotNull() & (F.size("box") > 0)
        & F.forall("box", lambda p: p.isNotNull())
        & F.col("text").isNotNull() & F.col("score").isNotNull()
    )
