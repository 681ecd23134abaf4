"""Box, crop-window and image-size expressions. Every function is Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIN_BOX = 8                       # shortest usable edge of a box or scaled image
SMALL_IMAGE = 400                 # below this longest edge, enlarging is tried first
LADDER_SMALL = (2.5, 2.0, 1.5, 1.0)
LADDER_LARGE = (1.0, 1.5, 2.0, 2.5)
SERVER_EDGE, CLIENT_EDGE = 2200, 1600


def normalise_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(
        F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"),
        F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"),
    )


def usable_box(box: Column, shortest: int = MIN_BOX) -> Column:
    return (box["x2"] - box["x1"] >= shortest) & (box["y2"] - box["y1"] >= shortest)


def crop_window(points: Column, width: Column, height: Column) -> Column:
    """Pixel window of a quadrilateral inside an image.

    Bounds are truncated, the lower ones are clamped at 0 and the upper ones end at the image.
    """
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    whole = lambda c: c.cast("bigint")  # noqa: E731 - cast truncates towards zero
    return F.struct(
        F.greatest(whole(F.array_min(xs)), F.lit(0)).alias("x0"),
        F.greatest(whole(F.array_min(ys)), F.lit(0)).alias("y0"),
        F.least(whole(F.array_max(xs)), width).alias("x1"),
        F.least(whole(F.array_max(ys)), height).alias("y1"),
    )


def window_is_empty(w: Column) -> Column:
    return (w["x1"] <= w["x0"]) | (w["y1"] <= w["y0"])


def corner_area(points: Column) -> Column:
    """Signed area spanned by the first and the third corner."""
    a, c = F.get(points, F.lit(0)), F.get(points, F.lit(2))
    return (c["x"] - a["x"]) * (c["y"] - a["y"])


def capped_size(h: Column, w: Column, longest: int) -> Column:
    """(height, width) scaled down so that the longest edge is at most ``longest``."""
    edge = F.greatest(h, w)
    scale = F.when(edge > longest, F.lit(float(longest)) / edge).otherwise(F.lit(1.0))
    size = lambda v: F.greatest(F.bround(v * scale), F.lit(1.0)).cast("bigint")
    return F.struct(size(h).alias("h"), size(w).alias("w"))


def scale_ladder(h: Column, w: Column) -> Column:
    """Scales to try, in order, as an array of doubles."""
    literal = lambda s: F.array(*[F.lit(v) for v in s])
    return F.when(F.greatest(h, w) < SMALL_IMAGE, literal(LADDER_SMALL)).otherwise(literal(LADDER_LARGE))


def border_for(h: Column, w: Column) -> Column:
    """White border of an attempt: a fifth of the longest edge, at least 16."""
    return F.greatest(F.lit(16), F.floor(F.greatest(h, w) * 0.2))
