"""Similarity, fusion and verdict expressions. Every function is Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values of the scoring rules.
HOG_WEIGHT = 0.35
COARSE_K = 50
TOP_K = 5
RANK_DECAY = 0.15
MIN_VALID = 0.55
MIN_AUTO = 0.60
FREE_FROM = 0.90
SUSPECT_FROM = 0.75


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def popcount(words: Column, n_words: int) -> Column:
    return _total([F.bit_count(F.get(words, F.lit(i))) for i in range(n_words)])


def overlap(a: Column, b: Column, n_words: int) -> Column:
    """Pixels inked in both bitmaps. Unrolled so that it stays in generated code."""
    return _total(
        [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i)))) for i in range(n_words)]
    )


def iou_from_counts(inter: Column, pop_a: Column, pop_b: Column) -> Column:
    union = pop_a + pop_b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou(a: Column, b: Column, n_words: int) -> Column:
    return iou_from_counts(overlap(a, b, n_words), popcount(a, n_words), popcount(b, n_words))


def _byte_sum(word: Column) -> Column:
    return _total([F.shiftright(word, 8 * k).bitwiseAND(F.lit(255)) for k in range(8)])


def byte_weighted_overlap(a: Column, b: Column, n_words: int) -> Column:
    """Overlap in which a pixel counts 128..1 by its place in its packed byte."""
    pairs = [(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(n_words)]
    inter = _total([_byte_sum(x.bitwiseAND(y)) for x, y in pairs])
    union = _total([_byte_sum(x.bitwiseOR(y)) for x, y in pairs])
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def array_total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return array_total(F.zip_with(a, b, lambda x, y: x * y))


def square_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once. A lambda would otherwise evaluate an
    outer expression again for every element it visits."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centre(a: Column) -> Column:
    return let(array_total(a) / F.size(a), lambda mean: F.transform(a, lambda v: v - mean))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def ncc_centred(a: Column, b: Column, ss_a: Column, ss_b: Column) -> Column:
    """Correlation of two centred fields whose square sums are known."""
    denom = F.sqrt(ss_a * ss_b)
    return F.when(denom < 1e-9, F.lit(0.0)).otherwise(clip01(dot(a, b) / denom))


def unit(a: Column, ss: Column) -> Column:
    """L2-normalise a vector whose square sum is known; a (near) zero vector stays as it is."""
    scale = F.when(F.sqrt(ss) > 1e-9, F.sqrt(ss)).otherwise(F.lit(1.0))
    return let(scale, lambda n: F.transform(a, lambda v: v / n))


def cosine_units(a: Column, b: Column) -> Column:
    return clip01(dot(a, b))


def fuse(field_score: Column, orientation_score: Column, weight: float = HOG_WEIGHT) -> Column:
    return field_score * (1.0 - weight) + orientation_score * weight


def verdict(score: Column, free_from: float = FREE_FROM, suspect_from: float = SUSPECT_FROM) -> Column:
    """Three licence classes; no evidence (null) is ``unknown`` and never ``risky``."""
    return (
        F.when(score.isNull(), "unknown")
        .when(score >= free_from, "free")
        .when(score >= suspect_from, "suspect")
        .otherwise("risky")
    )
