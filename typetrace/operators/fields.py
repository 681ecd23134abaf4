"""Feature extraction over glyph and crop tables: whole Arrow batches in, array columns out.

Every job here is a map over rows: no shuffle, and the columns it adds are written once with
the index, so that a search never works them out again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from typetrace.functions import rasters as R, scores as S

CELLS, BINS = 8, 8


def _map_columns(df: DataFrame, added: str, make: Callable[[pd.DataFrame], dict[str, list]]) -> DataFrame:
    """Add the columns of the DDL text ``added``, worked out by ``make`` for one batch."""
    new = T.StructType.fromDDL(added)
    keep = [f for f in df.schema.fields if f.name not in new.names]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**make(pdf))[[f.name for f in keep] + new.names]

    return df.mapInPandas(run, T.StructType(keep + new.fields))


def _images(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [R.as_image(p, h, w) for p, h, w in zip(pdf["px"], pdf["height"], pdf["width"])]


def _bitmaps(pdf: pd.DataFrame, side: int, column: str = "bits") -> np.ndarray:
    """Packed bitmap column to an (n, side, side) stack; a missing bitmap is blank."""
    n_words = side * side // 64
    blank = np.zeros(n_words, dtype=np.int64)
    words = [blank if v is None else v for v in pdf[column]]
    return R.unpack(words, n_words).reshape(len(pdf), side, side)


def _rows(a: np.ndarray) -> list[np.ndarray]:
    return list(a.reshape(len(a), -1))


def normalise_crops(crops: DataFrame, side: int = R.GLYPH_SIDE) -> DataFrame:
    """Threshold, polarity, trim, fit and centre every crop: adds ``bits``, null without ink."""
    def make(pdf):
        found = [R.normalise(g, side) for g in _images(pdf)]
        return {"bits": [None if b is None else R.pack(b.reshape(1, -1))[0] for b in found]}

    return _map_columns(crops, "bits array<bigint>", make).drop("px", "height", "width")


def crop_features(crops: DataFrame, side: int = R.GLYPH_SIDE, index_side: int = R.INDEX_SIDE, cells: int = CELLS) -> DataFrame:
    """Search columns of normalised crops: small bitmap, signed field, orientation histogram."""
    def make(pdf):
        big = _bitmaps(pdf, side)
        small = R.resize_nearest(big, index_side)
        return {
            "words": list(R.pack(small.reshape(len(pdf), -1))),
            "field": _rows(R.signed_field(small)),
            "vec": _rows(R.orientation_histogram(big, cells, BINS)),
        }

    added = "words array<bigint>, field array<double>, vec array<double>"
    return _with_pop(_map_columns(crops.filter(F.col("bits").isNotNull()), added, make), index_side)


def build_index(
    glyphs: DataFrame, side: int = R.GLYPH_SIDE, index_side: int = R.INDEX_SIDE, cells: int = CELLS, reach: int = 2
) -> DataFrame:
    """Search columns of every template; one whose ``bits`` are null stays blank and scores 0.

    The orientation histogram is taken from the stored small bitmap enlarged again, and the
    norms of all shifted fields are stored with it.
    """
    def make(pdf):
        small = R.resize_nearest(_bitmaps(pdf, side), index_side)
        field = R.signed_field(small)
        enlarged = R.resize_bilinear(small * 255, side, side) > R.HALF_LEVEL
        return {
            "words": list(R.pack(small.reshape(len(pdf), -1))),
            "field": _rows(field),
            "vec": _rows(R.orientation_histogram(enlarged, cells, BINS)),
            "moments": list(R.shift_moments(field, reach)),
        }

    added = "words array<bigint>, field array<double>, vec array<double>, moments array<double>"
    return _with_pop(_map_columns(glyphs, added, make).drop("bits"), index_side)


def compact(features: DataFrame) -> DataFrame:
    """Keep the array columns in single precision, which halves what an index stores and what a
    search shuffles. Scores are still summed in double precision."""
    floats = [c for c in ("field", "vec", "moments") if c in features.columns]
    return features.withColumns({c: F.col(c).cast("array<float>") for c in floats})


def _with_pop(df: DataFrame, side: int) -> DataFrame:
    return df.withColumn("pop", S.popcount(F.col("words"), side * side // 64))


def resize_bitmaps(df: DataFrame, side: int, to: int) -> DataFrame:
    """Nearest resize of packed bitmaps, as 0/1 arrays ``px``."""
    return _map_columns(df, "px array<int>", lambda pdf: {
        "px": _rows(R.resize_nearest(_bitmaps(pdf, side), to).astype(np.int32))})


def resize_levels(df: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear resize of level images of any size to one size."""
    def make(pdf):
        out = [R.resize_bilinear(g, height, width).astype(np.int32).ravel() for g in _images(pdf)]
        return {"px": out, "height": height, "width": width}

    return _map_columns(df, "px array<int>, height int, width int", make)


def distance_fields(df: DataFrame, side: int) -> DataFrame:
    return _map_columns(df, "dist array<double>", lambda pdf: {
        "dist": _rows(R.distance_to_background(_bitmaps(pdf, side)))})


def signed_fields(df: DataFrame, side: int) -> DataFrame:
    return _map_columns(df, "field array<double>", lambda pdf: {
        "field": _rows(R.signed_field(_bitmaps(pdf, side)))})


def shift_bitmaps(df: DataFrame, side: int, dy: int, dx: int) -> DataFrame:
    return _map_columns(df, "px array<int>", lambda pdf: {
        "px": _rows(R.shifted(_bitmaps(pdf, side), dy, dx).astype(np.int32))})


def orientation_histograms(df: DataFrame, side: int, cells: int = CELLS) -> DataFrame:
    return _map_columns(df, "vec array<double>", lambda pdf: {
        "vec": _rows(R.orientation_histogram(_bitmaps(pdf, side), cells, BINS))})


def aligned_scores(pairs: DataFrame, a: str, b: str, side: int, reach: int = 2) -> DataFrame:
    """Shift-tolerant correlation ``ncc`` of two field columns of the same row."""
    def make(pdf):
        stack = lambda c: np.stack([np.asarray(v, dtype=np.float64) for v in pdf[c]]).reshape(len(pdf), side, side)
        return {"ncc": R.aligned_pairs(stack(a), stack(b), reach)}

    return _map_columns(pairs, "ncc double", make)
