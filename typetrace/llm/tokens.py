"""Exact words of an Arrow text column, and benchmark items in parts of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb

ITEM_BYTES = 16 << 20  # texts of the items that are searched for at a time
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words of lower-cased text: digits, a to z, and all bytes of characters outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 256)]] = True


def spelled(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans (all maximal runs of ``inside``) as strings, without a copy each."""
    off = np.concatenate([[0], np.cumsum(end - start)])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(data[inside]))


def lower_words(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of each text, ASCII capitals lowered, and the first word of each text (and of none after)."""
    data = LOWER[data]
    inside = ALNUM[data]
    start, end, first = tb.spans(inside, off)
    return spelled(data, inside, start, end), first


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``start .. start + count`` one after the other, and which range each belongs to."""
    which = np.repeat(np.arange(len(start)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def item_parts(items: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = ITEM_BYTES) -> Iterator[pa.Table]:
    """Distinct rows with a text as tables ``item``, ``text`` of at most ``limit`` bytes of text, or one longer row.

    Rows are dealt by a hash into as many parts as that takes; only one part is with the driver at a time.
    """
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    size = F.octet_length("text").cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // limit))
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        if n == 1 or dealt.groupBy("part").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).filter(f"size > {limit} and n > 1").isEmpty():
            break
        n *= 2
    for part in range(n):
        yield dealt.filter(F.col("part") == part).select("item", "text").toArrow()
