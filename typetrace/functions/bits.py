"""Bitmap packing: 0/1 arrays to 64-bit words, first pixel in the highest bit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pack_word(ink: Column) -> Column:
    """Array of at most 64 zeros and ones to one signed 64-bit word."""
    return F.aggregate(
        ink,
        F.lit(0).cast("bigint"),
        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint")),
    )


def pack_words(ink: Column, n_words: int) -> Column:
    """Array of ``64 * n_words`` zeros and ones to words."""
    return F.array(*[pack_word(F.slice(ink, 64 * i + 1, 64)) for i in range(n_words)])
