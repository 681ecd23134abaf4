"""Repeatable random numbers from row keys: no generator state, no dependence on partitions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key(*parts: Column | int) -> Column:
    """Text key of a draw; different parts never give the same key."""
    return F.concat_ws("/", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def uniform(key: Column) -> Column:
    """52 bits of the key's digest as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")
    return (bits + 0.5) / 4503599627370496.0


def normal(key: Column) -> Column:
    """Box-Muller over two draws of the key."""
    radius, turn = uniform(F.concat(key, F.lit("/r"))), uniform(F.concat(key, F.lit("/t")))
    return F.sqrt(-2.0 * F.log(radius)) * F.cos(turn * 6.283185307179586)
