"""From levels to ink over pixel tables ``(image, y, x, level)``.

All per-image decisions come from one map-side combined summary of at most 256 rows per image,
so no image, however large, is ever gathered in one place and pixels are never joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def level_histogram(pixels: DataFrame, image: str = "image_id", level: str = "level") -> DataFrame:
    return pixels.groupBy(image, level).agg(F.count("*").alias("n"))


def level_summary(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Histogram with the extent of every level, enough for threshold, polarity and bounds."""
    return pixels.groupBy(image, "level").agg(
        F.count("*").alias("n"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"),
    )


def otsu_thresholds(hist: DataFrame, image: str = "image_id", level: str = "level") -> DataFrame:
    """Level with the largest between-class variance per image, the lowest one on ties.

    Absent levels repeat the variance of the level below them and lose the tie, so a sparse
    histogram is enough. An image of one level gets 0.
    """
    upto = W.partitionBy(image).orderBy(level).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(image)
    mass = (F.col("n") * F.col(level)).cast("double")
    running = hist.select(
        image, level,
        F.sum("n").over(upto).cast("double").alias("below"),
        F.sum("n").over(whole).cast("double").alias("total"),
        F.sum(mass).over(upto).alias("mass_below"),
        F.sum(mass).over(whole).alias("mass"),
    )
    above = F.col("total") - F.col("below")
    gap = F.col("mass_below") / F.col("below") - (F.col("mass") - F.col("mass_below")) / above
    variance = F.when(above > 0, F.col("below") * above * gap * gap)
    best = F.max_by(level, F.when(variance.isNotNull(), F.struct(variance, -F.col(level))))
    return running.groupBy(image).agg(F.coalesce(best, F.lit(0)).alias("threshold"))


def image_ink(summary: DataFrame, image: str = "image_id") -> DataFrame:
    """Threshold, ink side and tight ink bounds of every image.

    Dark pixels are those at or below the threshold. The minority side is ink, dark on a tie.
    ``x1`` and ``y1`` are exclusive; an image without ink has null bounds.
    """
    thr = otsu_thresholds(summary.select(image, "level", "n"), image)
    dark = F.col("level") <= F.col("threshold")
    # The summary is small per image, so this join moves at most 256 rows for an image.
    sides = (
        summary.join(thr, image)
        .groupBy(image, "threshold", dark.alias("dark"))
        .agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
             F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    )
    part = lambda side, c: F.max(F.when(F.col("dark") == side, F.col(c)))
    both = sides.groupBy(image, "threshold").agg(
        F.coalesce(part(True, "n"), F.lit(0)).alias("n_dark"),
        F.coalesce(part(False, "n"), F.lit(0)).alias("n_light"),
        *[part(True, c).alias(f"dark_{c}") for c in ("x0", "x1", "y0", "y1")],
        *[part(False, c).alias(f"light_{c}") for c in ("x0", "x1", "y0", "y1")],
    )
    dark_is_ink = F.col("n_dark") <= F.col("n_light")
    pick = lambda c: F.when(dark_is_ink, F.col(f"dark_{c}")).otherwise(F.col(f"light_{c}"))
    return both.select(
        image, "threshold", dark_is_ink.alias("dark_is_ink"),
        F.when(dark_is_ink, F.col("n_dark")).otherwise(F.col("n_light")).alias("n_ink"),
        pick("x0").alias("x0"), (pick("x1") + 1).alias("x1"),
        pick("y0").alias("y0"), (pick("y1") + 1).alias("y1"),
    )


def fitted_size(bounds: DataFrame, side: int) -> DataFrame:
    """Size and offset of the trimmed ink when it is fitted and centred into a square."""
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    scale = F.least(side / h, side / w)
    size = lambda v: F.greatest(F.bround(v * scale), F.lit(1.0)).cast("bigint")
    return bounds.withColumn("fit_h", size(h)).withColumn("fit_w", size(w)).withColumn(
        "top", F.expr(f"({side} - fit_h) div 2")
    ).withColumn("left", F.expr(f"({side} - fit_w) div 2"))


def projections(pixels: DataFrame, axis: str, image: str = "image_id") -> DataFrame:
    """Ink per column (``axis='x'``) or per row, with the extent of the ink along the other axis."""
    other = "y" if axis == "x" else "x"
    inked = F.when(F.col("ink") > 0, F.col(other))
    return pixels.groupBy(image, axis).agg(
        F.sum("ink").alias("ink"), F.min(inked).alias(f"{other}0"), F.max(inked).alias(f"{other}1")
    )


def masked_means(pixels: DataFrame, value: str, mask: str, image: str = "image_id") -> DataFrame:
    """Mean over the pixels of the mask, 0 where the mask is empty."""
    return pixels.groupBy(image).agg(
        F.coalesce(F.avg(F.when(F.col(mask) > 0, F.col(value))), F.lit(0.0)).alias("mean")
    )
