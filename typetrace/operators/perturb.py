"""Evaluation crops from a glyph table: every glyph in every mode, each repeatable from its key.

``glyphs(glyph_id, height, width, ink array<int>)`` become ``(glyph_id, mode, height, width, px)``.
Random numbers come from ``(glyph_id, pixel, seed)``, so a lost task makes the same crop again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from typetrace.functions import noise as N, rasters as R
from typetrace.functions.scores import let

MODES = ("clean", "noise", "background", "scale", "blur")


def _key(glyph: Column, slot: Column | int | str, seed: int) -> Column:
    """A draw belongs to a glyph, a slot (a pixel, or a name) and a seed."""
    return N.key(seed, glyph, slot if isinstance(slot, Column) else F.lit(slot))


def _level(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int")


def clean(ink: Column) -> Column:
    return F.transform(ink, lambda p: p * 255)


def noisy(ink: Column, glyph: Column, seed: int = 0) -> Column:
    """One offset N(0, 30) per image and N(0, 18) per pixel."""
    offset = N.normal(_key(glyph, "offset", seed)) * 30
    return let(offset, lambda o: F.transform(
        ink, lambda p, i: _level(p * 255 + o + N.normal(_key(glyph, i, seed)) * 18)))


def on_background(ink: Column, glyph: Column, width: Column, seed: int = 0) -> Column:
    """Dark ink on a light ramp or light ink on a dark ramp, half of the glyphs each."""
    u = lambda slot: N.uniform(_key(glyph, slot, seed))
    between = lambda v, lo, hi: lo + F.floor(v * (hi - lo + 1))
    dark_ink = u("side") < 0.5
    paper = F.when(dark_ink, between(u("paper"), 120, 220)).otherwise(between(u("paper"), 0, 70))
    pen = F.when(dark_ink, between(u("pen"), 0, 40)).otherwise(between(u("pen"), 190, 240))
    ramp = lambda x: F.when(width > 1, -25 + 50 * x / (width - 1)).otherwise(F.lit(0.0))
    return let(F.struct(paper.alias("paper"), pen.alias("pen")), lambda c: F.transform(
        ink, lambda p, i: F.when(p > 0, _level(c["pen"] + N.normal(_key(glyph, i, seed)) * 6))
        .otherwise(_level(c["paper"] + ramp(i % width)))))


def _resampled(df: DataFrame, mode: str, amount: Column) -> DataFrame:
    """Modes that re-sample the image: ``scale`` by a factor, ``blur`` by a radius."""
    def one(ink, h, w, a):
        levels = np.asarray(ink, dtype=np.float64).reshape(h, w) * 255
        if mode == "blur":
            return R.gaussian_blur(levels, a)
        return R.resize_bilinear(levels, max(8, int(h * a)), max(8, int(w * a)))

    def run(batches):
        for pdf in batches:
            out = [one(*v) for v in zip(pdf["ink"], pdf["height"], pdf["width"], pdf["amount"])]
            yield pd.DataFrame({
                "glyph_id": pdf["glyph_id"], "mode": mode,
                "height": [o.shape[0] for o in out], "width": [o.shape[1] for o in out],
                "px": [o.astype(np.int32).ravel() for o in out],
            })

    return df.withColumn("amount", amount).mapInPandas(
        run, "glyph_id bigint, mode string, height int, width int, px array<int>")


def evaluation_set(glyphs: DataFrame, modes: tuple[str, ...] = MODES, seed: int = 0) -> DataFrame:
    """All asked modes of every glyph in one table."""
    g, ink = F.col("glyph_id"), F.col("ink")
    drawn = {"clean": clean(ink), "noise": noisy(ink, g, seed),
             "background": on_background(ink, g, F.col("width"), seed)}
    level_modes = [F.struct(F.lit(m).alias("mode"), drawn[m].alias("px")) for m in modes if m in drawn]
    parts = []
    if level_modes:
        parts.append(glyphs.select(g, "height", "width", F.inline(F.array(*level_modes))).select(
            "glyph_id", "mode", "height", "width", "px"))
    if "scale" in modes:
        parts.append(_resampled(glyphs, "scale", 0.5 + N.uniform(_key(g, "scale", seed)) * 1.5))
    if "blur" in modes:
        parts.append(_resampled(glyphs, "blur", 0.5 + N.uniform(_key(g, "blur", seed))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
