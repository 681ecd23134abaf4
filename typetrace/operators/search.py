"""Template search: cheap bitmap overlap first, exact fused score on the survivors.

Crops carry ``request_id, mark_id, char, words, field, vec``; templates carry ``font_id, char,
words, field, vec`` and, when shifts are searched, ``moments``. ``vec`` has unit length.

Two physical forms give the same rows. ``match_marks`` finds short lists by bitmaps alone: against a
packed index that every task holds, if its counted size allows, so that no crop is moved; else in tasks
that crops' and templates' bitmaps of one character are dealt into. Crops then meet the fields of
their listed fonts in bounded tasks, which score with matrix products. ``match_marks_joined`` works on columns that are centred and
summed beforehand, keeps glyphs without a field, and may rank all pairs, by plain joins; it suits
small fields and the coarse-only mode, and never reads a field column in its coarse stage.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from typetrace.functions import rasters as R, scores as S
from typetrace.functions.bits import pack_words
from typetrace.session import cut_lineage


BITMAP_BYTES = 16 << 20  # of bitmaps of an index dealt to a task
QUERY_PARTS = 128        # of the queries of a whole index, at least


def with_features(df: DataFrame, field: str, n_words: int, ink: str | None = None) -> DataFrame:
    """Add the search columns to rows holding a small field; ink is where the field is positive
    unless an ink array column is named."""
    ink_array = F.col(ink) if ink else F.transform(field, lambda v: (v > 0).cast("int"))
    return (
        df.withColumn("words", pack_words(ink_array, n_words))
        .withColumn("pop", S.popcount(F.col("words"), n_words))
        .withColumn("vec", S.unit(F.col(field), S.square_sum(F.col(field))))
        .withColumn("centred", S.centre(F.col(field)))
        .withColumn("centred_ss", S.square_sum(F.col("centred")))
    )


def _first(df: DataFrame, keys: list[str], order: list, k: int | None, rank: str) -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def coarse_candidates(
    crops: DataFrame,
    templates: DataFrame,
    n_words: int,
    k: int | None = S.COARSE_K,
    coarse: str = "popcount",
    crops_per_part: int = 20_000,
    fonts_per_part: int | None = None,
) -> DataFrame:
    """Best ``k`` fonts of the crop's own character by bitmap overlap. Reads no field column.

    A hot character is joined in parts, so that it is not one task's work. A task gives out the best ``k`` it has alone; pairs
    become rows only if all are asked for.
    """
    if k is None:
        q = crops.select("request_id", "mark_id", "char", "words", "pop")
        t = templates.select("font_id", "char", F.col("words").alias("t_words"), F.col("pop").alias("t_pop"))
        q, t = deal(q, t, "char", crops_per_part, fonts_per_part or 10_000)
        words, t_words = F.col("words"), F.col("t_words")
        if coarse == "byte_weighted":
            score = S.byte_weighted_overlap(words, t_words, n_words)
        else:
            score = S.iou_from_counts(S.overlap(words, t_words, n_words), F.col("pop"), F.col("t_pop"))
        pairs = q.drop("q_parts", "t_parts").join(t.drop("q_parts", "t_parts"), ["char", "q_part", "t_part"]).select(
            "request_id", "mark_id", "char", "font_id", score.alias("iou"))
    else:
        types = dict(crops.dtypes) | {"font_id": dict(templates.dtypes)["font_id"]}
        keys, bits = ["char", "q_part", "t_part"], [f"w{i}" for i in range(n_words)]
        q, t = crops.select("request_id", "mark_id", "char", *bitmap_columns(n_words)), templates.select("font_id", "char", *bitmap_columns(n_words))
        q, t = deal(q, t, "char", crops_per_part, fonts_per_part or max(1000, BITMAP_BYTES // (8 * n_words + 16)))
        q, t = q.select("request_id", "mark_id", *bits, *keys), t.select("font_id", *bits, *keys)
        schema = ", ".join(f"{f} {types[f]}" for f in ("request_id", "mark_id", "font_id", "char")) + ", iou double"
        pairs = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(
            _coarse_lists(n_words, k, coarse == "byte_weighted", ["font_id"]), schema)
    return _first(pairs, ["mark_id"], [F.desc("iou"), F.asc("font_id")], k, "coarse_rank")


def refine(candidates: DataFrame, crops: DataFrame, templates: DataFrame) -> DataFrame:
    """Fused field and orientation score of every candidate row."""
    q = crops.select("mark_id", "centred", "centred_ss", "vec")
    t = templates.select(
        "font_id", "char",
        F.col("centred").alias("t_field"), F.col("centred_ss").alias("t_ss"), F.col("vec").alias("t_vec"),
    )
    return (
        candidates.join(t, ["font_id", "char"])
        .join(q, "mark_id")
        .withColumn("ncc", S.ncc_centred(F.col("centred"), F.col("t_field"), F.col("centred_ss"), F.col("t_ss")))
        .withColumn("cosine", S.cosine_units(F.col("vec"), F.col("t_vec")))
        .withColumn("score", S.fuse(F.col("ncc"), F.col("cosine")))
        .drop("centred", "centred_ss", "vec", "t_field", "t_ss", "t_vec")
    )


def refine_listed(candidates: DataFrame, crops: DataFrame, templates: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """As ``refine``, for candidates that are few to a crop: a crop carries its list to the tasks that hold a font of it, so that no
    field is copied for every pair. Fields that are not wholly known score 0."""
    whole = lambda c, name: F.when(F.forall(c, lambda v: v.isNotNull()), F.col(c)).alias(name)
    lists = candidates.groupBy("mark_id", "char", "request_id").agg(F.collect_list(F.struct("font_id", "iou", "coarse_rank")).alias("x"))
    q = crops.select("mark_id", whole("centred", "centred"), F.coalesce("centred_ss", F.lit(0.0)).alias("ss"), whole("vec", "vec"))
    listed = lists.join(q, "mark_id").select(
        "request_id", "mark_id", "char", "centred", "ss", "vec",
        F.col("x.font_id").alias("fonts"), F.col("x.iou").alias("ious"), F.col("x.coarse_rank").alias("ranks"))
    t = templates.select("font_id", "char", whole("centred", "centred"), F.coalesce("centred_ss", F.lit(0.0)).alias("ss"), whole("vec", "vec"))
    rows_per_task = rows_per_task or 32_768
    q, t = deal(listed, t, "char", rows_per_task, rows_per_task, crops, templates, "fonts")
    keys, own, fields = ["char", "q_part", "t_part"], ["request_id", "mark_id", "char"], ["centred", "ss", "vec"]
    q, t = q.select("request_id", "mark_id", *fields, "fonts", "ious", "ranks", *keys), t.select("font_id", *fields, *keys)
    types = dict(candidates.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*own, "font_id", "iou", "coarse_rank")) + ", ncc double, cosine double, score double"
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(_listed_scores, schema)


def _padded(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Arrays as rows of one matrix, and their lengths; -1 where there is none."""
    lengths = np.array([-1 if v is None else len(v) for v in column])
    out = np.zeros((len(column), max(1, lengths.max())))
    for i, v in enumerate(column):
        out[i, :max(0, lengths[i])] = () if v is None else v
    return out, lengths


def _listed_scores(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    """Scores of a task's crops with those of their listed fonts that the task has, every row of a repeated font."""
    columns = ["request_id", "mark_id", "char", "font_id", "iou", "coarse_rank", "ncc", "cosine", "score"]
    if q.empty or t.empty:
        return pd.DataFrame(columns=columns)
    t = t.sort_values("font_id", kind="stable")
    fonts, listed = t["font_id"].to_numpy(), np.concatenate(q["fonts"].to_list())
    first = np.searchsorted(fonts, listed)
    times = np.searchsorted(fonts, listed, side="right") - first
    pair = np.repeat(np.arange(len(listed)), times)
    place = np.repeat(first, times) + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
    rows = np.repeat(np.arange(len(q)), [len(f) for f in q["fonts"]])[pair]

    def products(name: str) -> np.ndarray:
        """Zero where one is not known; as in Spark, what is no number counts as the largest."""
        (a, n), (b, m) = _padded(q[name]), _padded(t[name])
        width, out = min(a.shape[1], b.shape[1]), np.zeros(len(rows))
        for i in range(0, len(rows), 8192):
            x, y = rows[i:i + 8192], place[i:i + 8192]
            out[i:i + 8192] = np.where((n[x] == m[y]) & (n[x] >= 0), np.einsum("ij,ij->i", a[x, :width], b[y, :width]), 0.0)
        return out

    clip = lambda x: np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0))
    denom = np.sqrt(q["ss"].to_numpy()[rows] * t["ss"].to_numpy()[place])
    flat = denom < 1e-9
    ncc = np.where(flat, 0.0, clip(products("centred") / np.where(flat, 1.0, denom)))
    cosine = clip(products("vec"))
    iou, rank = (np.concatenate(q[c].to_list())[pair] for c in ("ious", "ranks"))
    own = {c: q[c].to_numpy()[rows] for c in columns[:3]}
    return pd.DataFrame(own | {"font_id": fonts[place], "iou": iou, "coarse_rank": rank, "ncc": ncc, "cosine": cosine,
                               "score": weighted()(ncc, cosine)})[columns]


def match_marks_joined(
    crops: DataFrame,
    templates: DataFrame,
    n_words: int,
    coarse_k: int | None = S.COARSE_K,
    top_k: int = S.TOP_K,
    use_fields: bool = True,
    coarse: str = "popcount",
) -> DataFrame:
    """Short list of ``top_k`` fonts per crop with a 0-based ``rank``.

    ``use_fields=False`` is the coarse-only mode: the overlap itself is the score.
    """
    cands = coarse_candidates(crops, templates, n_words, coarse_k if use_fields else top_k, coarse)
    if not use_fields:
        return cands.withColumn("score", F.col("iou")).withColumn("rank", F.col("coarse_rank") - 1)
    scored = refine if coarse_k is None else refine_listed
    ranked = _first(
        scored(cands, crops, templates), ["mark_id"], [F.desc("score"), F.asc("font_id"), F.asc("coarse_rank")], top_k, "rank"
    )
    return ranked.withColumn("rank", F.col("rank") - 1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def overlap_matrix(q_bits: np.ndarray, t_bits: np.ndarray, byte_weighted: bool = False) -> np.ndarray:
    """Bitmap overlap of every query row with every template row, 0 where both are blank.

    ``byte_weighted`` sums packed bytes instead of pixels: the first pixel of eight weighs 128.
    """
    q, t = q_bits.astype(np.float32), t_bits.astype(np.float32)
    weight = (128 >> (np.arange(q.shape[1]) % 8) if byte_weighted else np.ones(q.shape[1])).astype(np.float32)
    inter = ((q * weight) @ t.T).astype(np.float64)
    union = (q @ weight).astype(np.float64)[:, None] + (t @ weight).astype(np.float64)[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


def first_k(iou: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of every row, largest first, earlier columns first on ties. Only values that
    can be among them are sorted."""
    n = iou.shape[1]
    if k >= n:
        return np.argsort(-iou, axis=1, kind="stable")
    least = np.partition(iou, n - k, axis=1)[:, n - k]
    rows, cols = np.nonzero(iou >= least[:, None])
    order = np.lexsort((cols, -iou[rows, cols], rows))
    starts = np.searchsorted(rows, np.arange(len(iou)))
    return cols[order][starts[:, None] + np.arange(k)[None, :]]


# From the field correlations and orientation cosines of pairs, in arrays of one shape, to their scores.
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def weighted(weight: float = S.HOG_WEIGHT) -> Scorer:
    """The default scorer, as ``scores.fuse``."""
    return lambda ncc, cosine: (1.0 - weight) * ncc + weight * cosine


def fused_matrix(q: pd.DataFrame, t: pd.DataFrame, side: int, reach: int, scorer: Scorer):
    """Field correlation, orientation cosine and their fusion for all rows of q against t."""
    qf = _stack(q["field"]).reshape(len(q), side, side)
    tf = _stack(t["field"]).reshape(len(t), side, side)
    moments = _stack(t["moments"]) if "moments" in t else R.shift_moments(tf, reach)
    ncc = R.aligned_correlation(qf, tf, moments, reach)
    cosine = np.clip(_stack(q["vec"]) @ _stack(t["vec"]).T, 0.0, 1.0)
    return ncc, cosine, scorer(ncc, cosine)


def _pair_products(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray, block: int) -> np.ndarray:
    parts = [slice(i, i + block) for i in range(0, len(rows), block)]
    return np.concatenate([np.einsum("ij,ij->i", a[rows[p]], b[columns[p]]) for p in parts])


def _shifted_products(
    centred: np.ndarray, target: np.ndarray, rows: np.ndarray, columns: np.ndarray, side: int, reach: int, block: int = 256
) -> np.ndarray:
    """Products of pairs for every shift of the row of ``centred``, which fetches its rows of ``target`` once."""
    shifts, order = R.shifts(reach), np.argsort(rows, kind="stable")
    starts, columns = np.searchsorted(rows[order], np.arange(len(centred) + 1)), columns[order]
    out = np.empty((len(rows), len(shifts)))
    for i in range(0, len(centred), block):
        some = centred[i:i + block].reshape(-1, side, side)
        moved = np.stack([R.shifted(some, -dy, -dx).reshape(len(some), -1) for dy, dx in shifts], axis=1)
        for own, a, b in zip(moved, starts[i:], starts[i + 1:]):
            if b > a:
                out[order[a:b]] = np.einsum("ij,sj->is", target[columns[a:b]], own)
    return out


def fused_pairs(q: pd.DataFrame, t: pd.DataFrame, rows: np.ndarray, columns: np.ndarray, side: int, reach: int, scorer: Scorer, block: int = 8192):
    """As ``fused_matrix``, of the pairs of row ``rows[i]`` of q and row ``columns[i]`` of t alone.

    Sums run along rows, not in blocks as those of matrices, so that equal fields score the same.
    """
    qf, target = _stack(q["field"]), _stack(t["field"])
    moments = _stack(t["moments"]) if "moments" in t else R.shift_moments(target.reshape(len(t), side, side), reach)
    centred = qf - qf.mean(axis=1, keepdims=True)
    energy = (centred ** 2).sum(axis=1)
    if reach:
        products = _shifted_products(centred, target, rows, columns, side, reach)
    else:
        products = _pair_products(centred, target, rows, columns, block)[:, None]
    ncc = np.zeros(len(rows))
    for j in range(products.shape[1]):
        denom = np.sqrt(np.maximum(energy[rows] * moments[columns, j], 0.0))
        np.maximum(ncc, np.where(denom < 1e-9, 0.0, products[:, j] / np.where(denom < 1e-9, 1.0, denom)), out=ncc)
    ncc = np.minimum(ncc, 1.0)
    cosine = np.clip(_pair_products(_stack(q["vec"]), _stack(t["vec"]), rows, columns, block), 0.0, 1.0)
    return ncc, cosine, scorer(ncc, cosine)


QUERY_BLOCK, TEMPLATE_BLOCK = 128, 4096  # bitmaps held against each other at a time


def bitmap_columns(n_words: int) -> list[Column]:
    """The words of a bitmap as columns ``w0``, ``w1`` and on. One that is not wholly known is blank, as nothing overlaps with it."""
    known = F.forall("words", lambda w: w.isNotNull())
    return [F.coalesce(F.when(known, F.get("words", F.lit(i))), F.lit(0)).cast("bigint").alias(f"w{i}") for i in range(n_words)]


def _words_of(rows: pd.DataFrame, n_words: int) -> np.ndarray:
    if "words" in rows:
        return np.stack([np.asarray(v, dtype=np.int64) for v in rows["words"]]).reshape(len(rows), n_words)
    return rows[[f"w{i}" for i in range(n_words)]].to_numpy(np.int64)


def ink_bands(pops: np.ndarray, size: int) -> np.ndarray:
    """Where bands of sorted ink counts begin, and their end: whole counts, put together until a band has ``size`` bitmaps."""
    edges = [0]
    for end in np.flatnonzero(np.diff(pops)) + 1:
        if end - edges[-1] >= size:
            edges.append(end)
    return np.array([*edges, len(pops)])


def _meeting(q: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Pixels inked in both bitmaps, of rows of q and columns of words."""
    found = np.bitwise_count(q[:, 0, None] & words[0])
    if len(words) > 1:
        found = found.astype(np.uint16)
        for i in range(1, len(words)):
            found += np.bitwise_count(q[:, i, None] & words[i])
    return found


def best_overlaps(q: np.ndarray, t: np.ndarray, k: int, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of t with the ``k`` largest overlaps with every row of q, largest first, earlier rows first on ties, and the overlaps.

    Bitmaps are rows of 64-bit words. Bands of t of similar ink count are visited, those that may overlap most first. The k-th overlap
    so far says how many pixels have to meet, so a pair below that costs no more than counting them. Given ``band``, the size of bands, it also
    rules out those whose best possible overlap (smaller count over larger) is lower. Neither changes a result.
    """
    q, t = (np.ascontiguousarray(x, dtype=np.int64).view(np.uint64) for x in (q, t))
    k = min(k, len(t))
    q_pop, t_pop = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (q, t))
    by_pop = np.argsort(t_pop, kind="stable")
    words, pops = np.ascontiguousarray(t[by_pop].T), t_pop[by_pop]
    edges = ink_bands(pops, band or TEMPLATE_BLOCK)
    low, high = pops[edges[:-1]], pops[edges[1:] - 1]
    place, best = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    by_ink = np.argsort(q_pop, kind="stable")
    for i in range(0, len(q), QUERY_BLOCK):
        some = by_ink[i:i + QUERY_BLOCK]
        ink, bits = q_pop[some], q[some]
        larger = np.maximum(ink[:, None], low)
        at_most = np.where(larger > 0, np.minimum(ink[:, None], high) / np.maximum(larger, 1), 1.0)
        kth, last = np.full(len(some), -1.0), np.zeros(len(some), np.int64)   # the k-th overlap so far, and its row of t
        held, new = [], 0

        def settle():
            rows, places, ious = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((places, -ious, rows))
            rows = rows[order]
            order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
            rows, places, ious = (np.concatenate(x)[order] for x in zip(*held))
            held[:] = [(rows, places, ious)]
            if len(rows) == k * len(some):
                kth[:], last[:] = ious[k - 1::k], places[k - 1::k]

        for b in np.argsort(-at_most.max(axis=0), kind="stable"):
            if band and not (at_most[:, b] >= kth).any():
                continue
            end = edges[b]
            while end < edges[b + 1]:
                part = slice(end, min(end + (TEMPLATE_BLOCK if kth[0] >= 0 else max(256, 4 * k)), edges[b + 1]))
                end = part.stop
                meet, inks = _meeting(bits, words[:, part]), pops[part]
                if kth[0] < 0:   # all rows get their first k at once
                    union = ink[:, None] + inks - meet
                    iou = np.where(union > 0, meet / np.maximum(union, 1), 0.0)
                    n = iou.shape[1]
                    hit = iou >= (np.partition(iou, n - k, axis=1)[:, n - k, None] if n > k else 0)
                else:
                    # meet / (ink + inks - meet) >= kth, solved for meet; rounding may let too many through, never too few.
                    share, counts, times = (kth / (1 + kth))[:, None], *np.unique(inks, return_counts=True)
                    need = np.ceil(share * (ink[:, None] + counts) - 1e-6).astype(meet.dtype)
                    hit = meet >= (need if len(counts) == 1 else np.repeat(need, times, axis=1))
                found = np.flatnonzero(hit)
                if not len(found):
                    continue
                rows, columns = np.divmod(found, len(inks))
                both = meet[rows, columns].astype(np.int64)
                union = ink[rows] + inks[columns] - both
                ious, places = np.where(union > 0, both / np.maximum(union, 1), 0.0), by_pop[part][columns]
                better = (ious > kth[rows]) | (ious == kth[rows]) & (places < last[rows])
                if not better.any():
                    continue
                held.append((rows[better], places[better], ious[better]))
                new += len(held[-1][0])
                if kth[0] < 0 or new > k * len(some):
                    settle()
                    new = 0
        settle()
        place[some], best[some] = held[0][1].reshape(-1, k), held[0][2].reshape(-1, k)
    return place, best


def _coarse_lists(
    n_words: int, k: int | None, byte_weighted: bool, order: list[str], band: int | None = None
) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Best ``k`` templates of a task for each of its queries, by overlap alone. Ties go by ``order``; ``band`` as in ``best_overlaps``."""
    keys = ["request_id", "mark_id"]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        own = [c for c in keys if c in q]
        columns = [*own, "font_id", "char", "iou"]
        if q.empty or t.empty:
            return pd.DataFrame(columns=columns)
        t = t.iloc[np.lexsort([pd.factorize(t[c], sort=True)[0] for c in reversed(order)])]
        q_words, t_words = _words_of(q, n_words), _words_of(t, n_words)
        if k is None or byte_weighted:
            t_bits, block = R.unpack(t_words, n_words), max(1, PAIR_BLOCK // len(t))
            parts = []
            for i in range(0, len(q), block):
                iou = overlap_matrix(R.unpack(q_words[i:i + block], n_words), t_bits, byte_weighted)
                keep = first_k(iou, len(t) if k is None else k)
                parts.append((keep, np.take_along_axis(iou, keep, axis=1)))
            keep, iou = (np.concatenate(x) for x in zip(*parts))
        else:
            keep, iou = best_overlaps(q_words, t_words, k, band)
        rows, place = np.repeat(np.arange(len(q)), keep.shape[1]), keep.ravel()
        out = {c: q[c].to_numpy()[rows] for c in own} | {c: t[c].to_numpy()[place] for c in ("font_id", "char")}
        return pd.DataFrame(out | {"iou": iou.ravel()})[columns]

    return run


def _short_lists(
    n_words: int, side: int, reach: int, coarse_k: int | None, scorer: Scorer, byte_weighted: bool
) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    columns = ["request_id", "mark_id", "char", "font_id", "iou", "ncc", "cosine", "score"]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame(columns=columns)
        t = t.sort_values("font_id", kind="stable").reset_index(drop=True)
        iou = overlap_matrix(R.unpack(q["words"], n_words), R.unpack(t["words"], n_words), byte_weighted)
        keep = np.argsort(-iou, axis=1, kind="stable")[:, :coarse_k]
        keep.sort(axis=1)                                    # back to font order for ties
        used = np.unique(keep)
        ncc, cosine, score = fused_matrix(q, t.iloc[used], side, reach, scorer)
        rows = np.arange(len(q))[:, None]
        place = np.searchsorted(used, keep)
        width = keep.shape[1]
        return pd.DataFrame({
            "request_id": np.repeat(q["request_id"].to_numpy(), width),
            "mark_id": np.repeat(q["mark_id"].to_numpy(), width),
            "char": np.repeat(q["char"].to_numpy(), width),
            "font_id": t["font_id"].to_numpy()[keep.ravel()],
            "iou": iou[rows, keep].ravel(),
            "ncc": ncc[rows, place].ravel(),
            "cosine": cosine[rows, place].ravel(),
            "score": score[rows, place].ravel(),
        })[columns]

    return run


PACKED_BYTES = 64 << 20  # of an index of bitmaps that every task may hold
FIELD_BYTES = 32 << 20   # of fields and orientations of each side in a task
PACKED_BLOCK = 4096      # templates unpacked at a time
LIST_BAND = 500          # templates of a band, at least, when short lists are made from a packed index
PAIR_BLOCK = 1 << 22     # overlaps held at a time


def packed_index(templates: DataFrame, n_words: int, limit: int = PACKED_BYTES) -> dict[str, tuple[np.ndarray, np.ndarray]] | None:
    """Font ids, in order, and words of every character's templates, or None if they take over ``limit`` bytes.

    The size is counted before anything is fetched.
    """
    if templates.select("font_id").count() * (8 * n_words + 16) > limit:
        return None
    got = templates.select("char", "font_id", "words").toArrow().to_pandas()
    index = {}
    for char, t in got.groupby("char"):
        t = t.sort_values("font_id", kind="stable")
        index[char] = t["font_id"].to_numpy(), np.stack(t["words"].to_list()).astype(np.int64).reshape(len(t), n_words)
    return index


def _listed(shared, n_words: int, k: int, byte_weighted: bool, keep: list[str]):
    """Rows of crops with the ``k`` best fonts of their character and the overlaps, from a packed index.

    Crops whose character has no template are left out.
    """
    def best(words: np.ndarray, t_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not byte_weighted:
            return best_overlaps(np.stack([np.asarray(v, dtype=np.int64) for v in words]).reshape(len(words), n_words), t_words, k, LIST_BAND)
        q = R.unpack(words, n_words)
        iou = np.concatenate([overlap_matrix(q, R.unpack(t_words[i:i + PACKED_BLOCK], n_words), byte_weighted)
                              for i in range(0, len(t_words), PACKED_BLOCK)], axis=1)
        place = first_k(iou, k)
        return place, np.take_along_axis(iou, place, axis=1)

    def run(batches):
        index = shared.value
        for batch in batches:
            rows, fonts, ious, ends = [], [], [], [0]
            words = batch.column("words").to_numpy(zero_copy_only=False)
            for char, at in pd.Series(batch.column("char").to_pandas()).groupby(batch.column("char").to_pandas()).indices.items():
                if char not in index:
                    continue
                font, t_words = index[char]
                block = max(1, PAIR_BLOCK // len(font))
                for i in range(0, len(at), block):
                    some = at[i:i + block]
                    place, iou = best(words[some], t_words)
                    rows.append(some)
                    fonts.append(font[place].ravel())
                    ious.append(iou.ravel())
                    ends += (ends[-1] + place.shape[1] * np.arange(1, len(some) + 1)).tolist()
            if not rows:
                continue
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (fonts, ious)]
            taken = batch.select(keep).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*taken.columns, *lists], [*keep, "fonts", "ious"])

    return run


def _fine_lists(side: int, reach: int, scorer: Scorer) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Fused scores of a task's crops with those of their listed fonts that the task has."""
    columns = ["request_id", "mark_id", "char", "font_id", "iou", "ncc", "cosine", "score"]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame(columns=columns)
        t = t.sort_values("font_id", kind="stable").reset_index(drop=True)
        fonts, rows = t["font_id"].to_numpy(), np.repeat(np.arange(len(q)), [len(f) for f in q["fonts"]])
        listed, iou = np.concatenate(q["fonts"].to_list()), np.concatenate(q["ious"].to_list())
        place = np.minimum(np.searchsorted(fonts, listed), len(fonts) - 1)
        here = fonts[place] == listed
        rows, iou, place = rows[here], iou[here], place[here]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        used, column = np.unique(place, return_inverse=True)
        ncc, cosine, score = fused_pairs(q, t.iloc[used], rows, column, side, reach, scorer)
        own = {c: q[c].to_numpy()[rows] for c in columns[:3]}
        return pd.DataFrame(own | {"font_id": fonts[place], "iou": iou, "ncc": ncc, "cosine": cosine, "score": score})[columns]

    return run


def deal(
    crops: DataFrame, templates: DataFrame, key: str, crops_per_task: int, fonts_per_task: int,
    crop_keys: DataFrame | None = None, template_keys: DataFrame | None = None, fonts: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Give both sides ``(key, q_part, t_part)`` so that no task holds more than the two bounds.

    A hot key gets as many crop parts as its load asks for, each with its own copy of the key's
    templates. Loads come from a count over the key column alone; if the sides are worked out
    row by row, ``crop_keys`` and ``template_keys`` name tables that have the key before that. With ``fonts``, an array
    column, a crop goes only to the template parts that hold one of them.
    """
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    load = (
        (crops if crop_keys is None else crop_keys).groupBy(key).agg(F.count("*").alias("n_q"))
        .join((templates if template_keys is None else template_keys).groupBy(key).agg(F.count("*").alias("n_t")), key)
        .select(key, parts("n_q", crops_per_task).alias("q_parts"), parts("n_t", fonts_per_task).alias("t_parts"))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n, *ids: F.pmod(F.xxhash64(*ids), F.col(n)).cast("int")
    holding = F.explode(F.array_distinct(F.transform(fonts, lambda f: share("t_parts", f, key)))) if fonts else every("t_parts")
    q = (crops.join(load, key).withColumn("q_part", share("q_parts", "mark_id"))
         .withColumn("t_part", holding))
    t = (templates.join(load, key).withColumn("t_part", share("t_parts", "font_id", "char"))
         .withColumn("q_part", every("q_parts")))
    return q, t


def match_marks(
    crops: DataFrame,
    templates: DataFrame,
    n_words: int,
    side: int,
    reach: int = 0,
    coarse_k: int | None = S.COARSE_K,
    top_k: int = S.TOP_K,
    weight: float = S.HOG_WEIGHT,
    crops_per_task: int | None = None,
    fonts_per_task: int | None = None,
    use_fields: bool = True,
    coarse: str = "popcount",
    crop_keys: DataFrame | None = None,
    template_keys: DataFrame | None = None,
    packed_bytes: int = PACKED_BYTES,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Short list of ``top_k`` fonts per crop with a 0-based ``rank``, shifts up to ``reach``.

    A crop whose character has no template yields no row. ``use_fields=False`` is the coarse-only
    mode: the overlap is the score, and no field leaves its row. An index of bitmaps of at most
    ``packed_bytes`` is held by every task; ``coarse_k=None`` holds every crop against all fields of its character. A ``scorer``
    takes the place of the weighted sum. Without given bounds, a task that scores listed pairs holds ``FIELD_BYTES`` of fields a side.
    """
    scorer = scorer or weighted(weight)
    fields_per_task = None if crops_per_task or fonts_per_task else max(1000, FIELD_BYTES // (16 * side * side))
    crops_per_task, fonts_per_task = crops_per_task or 1000, fonts_per_task or 2000
    byte_weighted, types = coarse == "byte_weighted", dict(crops.dtypes) | {"font_id": dict(templates.dtypes)["font_id"]}
    keys = ["char", "q_part", "t_part"]

    def dealt_lists(k: int | None) -> DataFrame:
        # Overlap alone is cheap per pair, so crops travel in larger parts and templates in fewer copies.
        q, t = deal(crops, templates, "char", 20 * crops_per_task, fonts_per_task, crop_keys, template_keys)
        q, t = q.select("request_id", "mark_id", "words", *keys), t.select("font_id", "words", *keys)
        schema = ", ".join(f"{f} {types[f]}" for f in ("request_id", "mark_id", "font_id", "char")) + ", iou double"
        return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(_coarse_lists(n_words, k, byte_weighted, ["font_id"]), schema)

    def packed_lists(k: int, keep: list[str]) -> DataFrame | None:
        index = packed_index(templates, n_words, packed_bytes)
        if index is None:
            return None
        shared = crops.sparkSession.sparkContext.broadcast(index)
        schema = ", ".join(f"{f} {types[f]}" for f in keep) + f", fonts array<{types['font_id']}>, ious array<double>"
        return crops.select(*keep, *([] if "words" in keep else ["words"])).mapInArrow(_listed(shared, n_words, k, byte_weighted, keep), schema)

    if not use_fields:
        listed = packed_lists(top_k, ["request_id", "mark_id", "char"]) if top_k else None
        if listed is None:
            found = dealt_lists(top_k)
        else:
            pair = F.explode(F.arrays_zip("fonts", "ious"))
            found = listed.withColumn("x", pair).select("request_id", "mark_id", F.col("x.fonts").alias("font_id"), "char", F.col("x.ious").alias("iou"))
        ranked = _first(found, ["mark_id"], [F.desc("iou"), F.asc("font_id")], top_k, "rank")
        return ranked.withColumn("score", F.col("iou")).withColumn("rank", F.col("rank") - 1)
    optional = ["moments"] if "moments" in templates.columns else []
    if coarse_k is None:
        q, t = deal(crops, templates, "char", crops_per_task, fonts_per_task, crop_keys, template_keys)
        q, t = q.select("request_id", "mark_id", "words", "field", "vec", *keys), t.select("font_id", "words", "field", "vec", *optional, *keys)
        score = _short_lists(n_words, side, reach, None, scorer, byte_weighted)
    else:
        fields = ["request_id", "mark_id", "char", "field", "vec"]
        listed = packed_lists(coarse_k, fields)
        if listed is None:
            lists = _first(dealt_lists(coarse_k), ["mark_id"], [F.desc("iou"), F.asc("font_id")], coarse_k, "coarse_rank").groupBy("mark_id").agg(
                F.sort_array(F.collect_list(F.struct("font_id", "iou"))).alias("x"))
            listed = crops.select(*fields).join(lists.select("mark_id", F.col("x.font_id").alias("fonts"), F.col("x.iou").alias("ious")), "mark_id")
        # Only listed pairs are scored, so a task may hold as many small fields as its memory allows, and fewer copies travel.
        q, t = deal(listed, templates, "char", fields_per_task or crops_per_task, fields_per_task or fonts_per_task,
                    crops if crop_keys is None else crop_keys, template_keys, "fonts")
        q, t = q.select("request_id", "mark_id", "field", "vec", "fonts", "ious", *keys), t.select("font_id", "field", "vec", *optional, *keys)
        score = _fine_lists(side, reach, scorer)
    schema = ", ".join(f"{f} {types[f]}" for f in ("request_id", "mark_id", "char", "font_id")) + ", iou double, ncc double, cosine double, score double"
    found = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(score, schema)
    # Parts of one character meet here. Both rankings share the shuffle on mark_id.
    found = _first(found, ["mark_id"], [F.desc("iou"), F.asc("font_id")], coarse_k, "coarse_rank")
    ranked = _first(found, ["mark_id"], [F.desc("score"), F.asc("font_id")], top_k, "rank")
    return ranked.withColumn("rank", F.col("rank") - 1).drop("coarse_rank")


GRID_K = 10


def refined_pairs(pairs: DataFrame, queries: DataFrame, templates: DataFrame, side: int, reach: int, scorer: Scorer, block: int = 512) -> DataFrame:
    """Fused score of (query, template) rows. Only these few fetch their fields, one side at a time."""
    q = queries.select("mark_id", F.col("field").alias("q_field"), F.col("vec").alias("q_vec"))
    t = templates.select("font_id", "char", F.col("field").alias("t_field"), F.col("vec").alias("t_vec"))
    both = pairs.join(t, ["font_id", "char"]).join(q, "mark_id")
    keep = [f for f in pairs.schema.fields]

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), block):
                part = pdf.iloc[i:i + block]
                qf, tf = (_stack(part[c]).reshape(len(part), side, side) for c in ("q_field", "t_field"))
                ncc = R.aligned_pairs(qf, tf, reach)
                cosine = np.clip((_stack(part["q_vec"]) * _stack(part["t_vec"])).sum(axis=1), 0.0, 1.0)
                yield part[[f.name for f in keep]].assign(ncc=ncc, cosine=cosine, score=scorer(ncc, cosine))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)
    return both.mapInPandas(run, f"{ddl}, ncc double, cosine double, score double")


def search_grid(
    queries: DataFrame,
    templates: DataFrame,
    n_words: int,
    side: int,
    reach: int = 0,
    k: int = GRID_K,
    weight: float = S.HOG_WEIGHT,
    prune: bool = True,
    queries_per_task: int | None = None,
    templates_per_task: int = 2000,
    coarse: str = "popcount",
    scorer: Scorer | None = None,
    bitmap_bytes: int = BITMAP_BYTES,
) -> DataFrame:
    """Best ``k`` templates of the whole (font x character) index per query bitmap by overlap,
    re-ranked by fused score; ``rank`` is 0-based.

    Tasks hold a part of the queries and ``bitmap_bytes`` of the index, which is mostly all of it, cut into bands of at least
    ``templates_per_task`` of similar ink count. A query first visits the band of its own
    count; the k-th overlap found there then rules out every band whose best possible overlap
    is lower, which changes no result. A task only returns its
    first ``k`` rows per query, and only bitmaps travel; the ``k`` rows left fetch their fields.
    Byte-weighted overlaps have no such bound and visit every band. A ``scorer`` takes the place of the weighted sum.
    """
    byte_weighted = coarse == "byte_weighted"
    n_queries, n_templates = queries.count(), templates.count()
    # The index is copied for every part of the queries, so there are no more of them than keep the cluster busy.
    queries_per_task = queries_per_task or min(20_000, max(1000, -(-n_queries // QUERY_PARTS)))
    q_parts, t_parts = max(1, -(-n_queries // queries_per_task)), max(1, -(-n_templates * (8 * n_words + 16) // bitmap_bytes))
    share = lambda n, *ids: F.pmod(F.xxhash64(*ids), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("mark_id", *bitmap_columns(n_words), share(q_parts, "mark_id").alias("q_part")).withColumn("t_part", every(t_parts))
    t = templates.select("font_id", "char", *bitmap_columns(n_words), share(t_parts, "font_id", "char").alias("t_part")).withColumn("q_part", every(q_parts))
    keys = ["q_part", "t_part"]
    schema = f"mark_id {dict(q.dtypes)['mark_id']}, font_id {dict(t.dtypes)['font_id']}, char string, iou double"
    found = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(
        _coarse_lists(n_words, k, byte_weighted, ["font_id", "char"], templates_per_task if prune else None), schema)
    found = _first(found, ["mark_id"], [F.desc("iou"), F.asc("font_id"), F.asc("char")], k, "coarse_rank")
    found = refined_pairs(found.drop("coarse_rank"), queries, templates, side, reach, scorer or weighted(weight))
    ranked = _first(found, ["mark_id"], [F.desc("score"), F.asc("font_id"), F.asc("char")], None, "rank")
    return ranked.withColumn("rank", F.col("rank") - 1)
