"""Level arithmetic on pixel arrays and channel columns. Every function is Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

INK_ABOVE = 32   # fixed threshold between paper and ink


def threshold(px: Column, above: int = INK_ABOVE) -> Column:
    """Level array to a 0/1 array, strictly above the threshold."""
    return F.transform(px, lambda p: (p > above).cast("int"))


def channel_mean(*channels: Column) -> Column:
    return F.floor(reduce(lambda a, b: a + b, channels) / len(channels))


def weighted_gray(b: Column, g: Column, r: Column) -> Column:
    return F.floor(0.114 * b + 0.587 * g + 0.299 * r)


def gray_array(px: Column, channels: Column, weighted: bool = False) -> Column:
    """Interleaved level array of 1, 3 or 4 channels (blue first) to gray: channel mean, or weights.

    A fourth channel is opacity and does not count.
    """
    at = F.sequence(F.lit(0), F.floor(F.size(px) / channels).cast("int") - 1)
    level = lambda i, c: F.get(px, (i * channels + c).cast("int"))
    mix = weighted_gray if weighted else channel_mean
    gray = F.transform(at, lambda i: mix(level(i, 0), level(i, 1), level(i, 2)).cast("int"))
    return F.when(channels == 1, px).when(F.size(px) > 0, gray).otherwise(px)


def saturating_add(a: Column, b: Column) -> Column:
    return F.least(F.greatest(a + b, F.lit(0)), F.lit(255))


def invert(a: Column) -> Column:
    return 255 - a


def masked_and(a: Column, b: Column, mask: Column) -> Column:
    """Bitwise and of two levels and the raw mask value; 0 where the mask is 0."""
    return a.bitwiseAND(b).bitwiseAND(mask)
