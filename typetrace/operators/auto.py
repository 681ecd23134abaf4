"""Automatic flow over detected text lines: ink, segments, routes, searches and outcomes.

A line row is ``(image_id, line_id, line_no, height, width, px, text, score, box)``. Line images
are only ever joined with their own segment list and go through map stages; shuffles carry
column extents, segments, search columns and votes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from typetrace.functions import boxes as B, rasters as R, scores as S, text as T
from typetrace.operators import catalog, fields as D, search, segment as G, vote
from typetrace.session import cut_lineage
from typetrace.sources.lines import complete_lines

MAX_LINES = 3
LINE_SURE_FROM = 0.6   # below this the text of a line is not trusted


@dataclass(frozen=True)
class Shape:
    """Sizes of normalised glyphs, stored bitmaps, orientation cells and the shift search."""

    side: int = R.GLYPH_SIDE
    index_side: int = R.INDEX_SIDE
    cells: int = D.CELLS
    reach: int = 2

    @property
    def n_words(self) -> int:
        return self.index_side ** 2 // 64


def largest_lines(lines: DataFrame, image: str = "image_id", top: int | None = MAX_LINES) -> DataFrame:
    """The ``top`` lines of each image by box area (all for None), earlier lines first on ties."""
    w = W.partitionBy(image).orderBy(F.desc("area"), F.asc("line_no"))
    sized = lines.withColumn("area", B.corner_area(F.col("box"))).withColumn("rank", F.row_number().over(w))
    return sized if top is None else sized.filter(F.col("rank") <= top)


def line_route(score: Column, n_chars: Column, n_segs: Column, labels_agree: Column) -> Column:
    """``free`` searches without the text, ``guided`` trusts it, ``skip`` has nothing to compare."""
    return (
        F.when(score < LINE_SURE_FROM, "free")
        .when(n_chars == 0, "skip")
        .when(n_segs != n_chars, "free")
        .when(~F.coalesce(labels_agree, F.lit(False)), "free")
        .otherwise("guided")
    )


def image_outcome(n_free_votes: Column, n_marks: Column) -> Column:
    """``mixed`` once any vote came without text, else ``guided``, or ``none`` without a mark."""
    return F.when(n_free_votes > 0, "mixed").when(n_marks > 0, "guided").otherwise("none")


def with_ink(lines: DataFrame) -> DataFrame:
    """Add the ink mask and the runs of inked columns; lines without ink are dropped.

    A line image is one row, so its column runs are found in place and no column is shuffled.
    """
    keep = [f for f in lines.schema.fields]
    names = [f.name for f in keep]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                ink = R.ink_of(R.as_image(row.px, row.height, row.width))
                if ink is None:
                    rows.append((None,) * 5)
                    continue
                rows.append((ink.astype(np.uint8).tobytes(), *R.runs_of(ink)))
            made = pd.DataFrame(rows, columns=["ink", "x0", "x1", "y0", "y1"], index=pdf.index)
            yield pd.concat([pdf[names], made], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    runs = ", ".join(f"{c} array<bigint>" for c in ("x0", "x1", "y0", "y1"))
    out = lines.mapInPandas(run, f"{ddl}, ink binary, {runs}")
    return out.filter(F.col("ink").isNotNull())


def line_runs(inked: DataFrame) -> DataFrame:
    """Runs of inked columns of every line, one row each."""
    return inked.select("line_id", F.inline(F.arrays_zip("x0", "x1", "y0", "y1")))


def _cut(inked: DataFrame, segs: DataFrame, extra: str, one) -> DataFrame:
    """Map each line with its own segment list to one row per segment; ``one`` makes its columns."""
    fields = [c for c in segs.columns if c != "line_id"]
    lists = segs.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("s"))
    lists = lists.select("line_id", *[F.col(f"s.{f}").alias(f"s_{f}") for f in fields])
    images = inked.select("line_id", "height", "width", "px", "ink").join(lists, "line_id")
    types = dict(segs.dtypes)
    schema = f"line_id {types['line_id']}, " + ", ".join(f"{f} {types[f]}" for f in fields) + f", {extra}"

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                gray = R.as_image(r.px, r.height, r.width)
                ink = np.frombuffer(r.ink, np.uint8).reshape(r.height, r.width)
                for values in zip(*[getattr(r, f"s_{f}") for f in fields]):
                    seg = dict(zip(fields, values))
                    made = one(gray, ink, int(seg["x0"]), int(seg["x1"]))
                    if made is not None:
                        rows.append((r.line_id, *values, *made))
            names = ["line_id", *fields, *[c.split()[0] for c in extra.split(", ")]]
            yield pd.DataFrame(rows, columns=names)

    return images.mapInPandas(run, schema)


def segment_bitmaps(inked: DataFrame, segs: DataFrame, side: int) -> DataFrame:
    """Rows trimmed, fitted and centred bitmap ``bits`` of every segment of the ink mask."""
    def one(gray, ink, x0, x1):
        sub = ink[:, x0:x1]
        rows = np.flatnonzero(sub.any(axis=1))
        if not len(rows):
            return None
        fitted = R.fit_and_centre(sub[rows[0]:rows[-1] + 1], side)
        return (R.pack(fitted.reshape(1, -1))[0],)

    return _cut(inked, segs, "bits array<bigint>", one)


def mark_images(inked: DataFrame, segs: DataFrame) -> DataFrame:
    """Gray image of every segment, cut to the rows of its ink."""
    def one(gray, ink, x0, x1):
        rows = np.flatnonzero(ink[:, x0:x1].any(axis=1))
        if not len(rows):
            return None
        sub = gray[rows[0]:rows[-1] + 1, x0:x1]
        return sub.shape[0], sub.shape[1], sub.tobytes()

    return _cut(inked, segs, "height int, width int, px binary", one)


def untrimmed_bitmaps(marks: DataFrame, side: int) -> DataFrame:
    """Bitmap of a mark for the label check: its own ink, rows trimmed, full width kept."""
    def run(batches):
        for pdf in batches:
            bits = []
            for r in pdf.itertuples(index=False):
                ink = R.ink_of(R.as_image(r.px, r.height, r.width))
                if ink is None:
                    bits.append(None)
                    continue
                rows = np.flatnonzero(ink.any(axis=1))
                bits.append(R.pack(R.fit_and_centre(ink[rows[0]:rows[-1] + 1], side).reshape(1, -1))[0])
            yield pd.DataFrame({"mark_id": pdf["mark_id"], "bits": bits})

    return marks.select("mark_id", "height", "width", "px").mapInPandas(
        run, f"mark_id {dict(marks.dtypes)['mark_id']}, bits array<bigint>")


def cut_windows(images: DataFrame, boxes: DataFrame, window: Column) -> DataFrame:
    """Pixels of ``boxes(image_id, ..)`` cut from ``images(image_id, height, width, px array)``.

    ``window`` is a struct of x0, y0, x1, y1 worked out from the box and the image's ``height`` and
    ``width``; an empty one yields no row. Other columns of ``boxes`` go along.
    """
    w, keep = F.col("_w"), [c for c in boxes.columns if c not in ("height", "width", "px")]
    row = lambda y: F.slice("px", (y * F.col("width") + w["x0"] + 1).cast("int"), (w["x1"] - w["x0"]).cast("int"))
    cut = boxes.select(*keep).join(images.select("image_id", "height", "width", "px"), "image_id").withColumn("_w", window)
    # Pixels first: inside a lambda, a name of the same select would win over the image's own column.
    cut = cut.filter(~B.window_is_empty(w)).withColumn("_px", F.flatten(F.transform(F.sequence(w["y0"], w["y1"] - 1), row)))
    return cut.select(
        *keep, (w["y1"] - w["y0"]).cast("int").alias("height"), (w["x1"] - w["x0"]).cast("int").alias("width"), F.col("_px").alias("px"))


def cut_lines(images: DataFrame, lines: DataFrame) -> DataFrame:
    """Line images of complete OCR lines, cut from their images by the lines' boxes."""
    return cut_windows(images, complete_lines(lines), B.crop_window(F.col("box"), F.col("width"), F.col("height")))


def text_free_search(
    bitmaps: DataFrame, templates: DataFrame, shape: Shape, k: int = search.GRID_K
) -> DataFrame:
    """Search of segment bitmaps ``(mark_id, bits)`` over the whole index."""
    # The search reads its queries several times; features are worked out once and stored.
    features = cut_lineage(D.crop_features(bitmaps, shape.side, shape.index_side, shape.cells))
    return search.search_grid(features, templates, shape.n_words, shape.index_side, shape.reach, k)


def sure_and_usable(found: DataFrame, floor: float = S.MIN_AUTO) -> DataFrame:
    """Best template of each segment, when it is sure enough and a character that can be judged."""
    usable = F.size(T.usable_chars(F.col("char"))) > 0
    return found.filter((F.col("rank") == 0) & (F.col("score") >= floor) & usable)


def labels_agree(marks: DataFrame, found: DataFrame, floor: float = S.MIN_AUTO) -> DataFrame:
    """Per line: does the best template of every mark carry the mark's own label, sure enough?"""
    best = found.filter(F.col("rank") == 0).select("mark_id", F.col("char").alias("read"), "score")
    right = F.coalesce((F.col("read") == F.col("char")) & (F.col("score") >= floor), F.lit(False))
    return marks.select("line_id", "mark_id", "char").join(best, "mark_id", "left").groupBy("line_id").agg(
        F.every(right).alias("agree"))


def _mark_key(guided: bool) -> Column:
    return F.concat_ws("/", F.col("line_id").cast("string"), F.lit("g" if guided else "f"), F.col("seg_no").cast("string"))


def free_votes(
    inked: DataFrame, templates: DataFrame, shape: Shape, floor: float = S.MIN_AUTO, k: int = search.GRID_K, listed: int = 3
) -> DataFrame:
    """Votes of lines read without their text: merge fragments, split wide pieces, search each.

    ``top`` holds the first ``listed`` templates of a segment.
    """
    pieces = G.split_wide(G.merge_fragments(line_runs(inked), inked.select("line_id", "width")))
    numbered = pieces.withColumn("seg_no", F.row_number().over(W.partitionBy("line_id").orderBy("x0", "part")) - 1)
    bitmaps = segment_bitmaps(inked, numbered.select("line_id", "seg_no", "x0", "x1"), shape.side)
    keyed = bitmaps.withColumn("mark_id", _mark_key(False))
    found = text_free_search(keyed.select("mark_id", "bits"), templates, shape, k).filter(F.col("rank") < max(listed, 1))
    tops = found.groupBy("mark_id").agg(F.sort_array(F.collect_list(F.struct("rank", "font_id", "char", "score"))).alias("top"))
    best = sure_and_usable(found, floor).join(tops, "mark_id")
    place = F.split("mark_id", "/")
    return best.select(
        F.get(place, F.lit(0)).alias("line_id"), F.get(place, F.lit(2)).cast("int").alias("seg_no"),
        "font_id", "char", "score", "top")


NOTHING_COMPARED = "no character could be compared"


def auto_match(
    lines: DataFrame,
    templates: DataFrame,
    groups: DataFrame,
    shape: Shape = Shape(),
    max_lines: int | None = MAX_LINES,
    max_chars: int | None = T.MAX_LINE_CHARS,
    fonts: DataFrame | None = None,
    coarse_k: int | None = S.COARSE_K,
    grid_k: int = search.GRID_K,
    top_k: int | None = S.TOP_K,
    floor: float = S.MIN_AUTO,
    listed: int = 3,
) -> dict[str, DataFrame]:
    """Outcome of every image over its largest complete lines.

    ``lines`` has their routes, ``candidates`` the groups in order with the first character each was
    seen for, ``segments`` the first ``listed`` templates of every segment read without text,
    ``chars_used`` the characters in the order of candidates, ``images`` verdicts and notes. With
    ``fonts``, candidates carry name, licence and source.

    ``line_id`` is text without a slash. A line with score 0 is always read without its text,
    which is also how an image in which no line was detected is passed in.
    """
    top = largest_lines(complete_lines(lines), top=max_lines).drop("area", "box")
    inked = cut_lineage(with_ink(top))   # every branch below reads it
    widths = inked.select("line_id", "width")
    kept = cut_lineage(G.number_segments(G.drop_narrow(G.long_enough(line_runs(inked), widths))))
    chars = inked.select("line_id", F.posexplode(T.line_chars(F.col("text"), max_chars)).alias("seg_no", "char"))
    n_segs = kept.groupBy("line_id").agg(F.count("*").alias("n_segs"))
    plan = (
        inked.select("image_id", "line_id", F.col("rank").alias("line_rank"), "score",
                     F.size(T.line_chars(F.col("text"), max_chars)).alias("n_chars"))
        .join(n_segs, "line_id", "left").fillna(0, ["n_segs"])
    )

    # Lines whose text may be trusted: pair segments with characters and check every label.
    maybe = plan.filter(line_route(F.col("score"), F.col("n_chars"), F.col("n_segs"), F.lit(True)) == "guided")
    paired = kept.join(chars, ["line_id", "seg_no"]).join(maybe.select("line_id"), "line_id", "left_semi")
    marks = mark_images(inked, paired.select("line_id", "seg_no", "char", "x0", "x1"))
    marks = cut_lineage(marks.withColumn("mark_id", _mark_key(True)))
    read = text_free_search(untrimmed_bitmaps(marks, shape.side), templates, shape, grid_k)
    agree = labels_agree(marks, read, floor)
    routed = plan.join(agree, "line_id", "left").withColumn(
        "route", line_route(F.col("score"), F.col("n_chars"), F.col("n_segs"), F.col("agree")))
    routed = routed.select("image_id", "line_id", "line_rank", "route")
    cut_routes = cut_lineage(routed)   # both searches below branch on it

    of_route = lambda df, r: df.join(
        cut_routes.filter(F.col("route") == r).select("line_id"), "line_id", "left_semi")
    free = cut_lineage(free_votes(of_route(inked, "free"), templates, shape, floor, grid_k, listed))
    trusted = of_route(marks, "guided").join(cut_routes.select("line_id", "image_id", "line_rank"), "line_id")
    crops = cut_lineage(D.crop_features(
        D.normalise_crops(trusted.withColumnRenamed("image_id", "request_id"), shape.side),
        shape.side, shape.index_side, shape.cells))
    tops = cut_lineage(search.match_marks(
        crops, templates, shape.n_words, shape.index_side, shape.reach, coarse_k, S.TOP_K if top_k is None else top_k, crop_keys=trusted))
    order = F.struct("late", "line_rank", "seg_no")
    free_seen = free.join(cut_routes.select("line_id", "image_id", "line_rank"), "line_id").withColumn("late", F.lit(0))
    mark_place = trusted.select("mark_id", "line_rank", "seg_no")
    guided_seen = (
        tops.filter((F.col("rank") == 0) & (F.col("score") >= floor)).join(mark_place, "mark_id")
        .withColumnRenamed("request_id", "image_id").withColumn("late", F.lit(1))
    )
    as_votes = lambda df: vote.with_group(df, groups).select(
        F.col("image_id").alias("request_id"), "group_id", "score", "char", order.alias("ord"), "late")
    seen = cut_lineage(vote.merge_votes(as_votes(free_seen), as_votes(guided_seen)))
    counted = vote.counted_votes(seen)

    marked = trusted.groupBy(F.col("image_id").alias("request_id")).agg(F.count("*").alias("n_marks"))
    freed = seen.filter(F.col("late") == 0).groupBy("request_id").agg(F.count("*").alias("n_free"))
    images = (
        lines.select(F.col("image_id").alias("request_id")).distinct()
        .join(marked, "request_id", "left").join(freed, "request_id", "left").fillna(0, ["n_marks", "n_free"])
        .withColumn("outcome", image_outcome(F.col("n_free"), F.col("n_marks")))
    )
    has = lambda df, o: df.join(
        images.filter(F.col("outcome") == o).select("request_id"), "request_id", "left_semi")
    every = vote.rank_candidates(has(counted, "mixed"), min_score=None, top_k=None, by_votes=True)
    mixed = (every if top_k is None else every.filter(F.col("rank") <= top_k)).select(
        "request_id", "group_id", "score", "votes", "rank", "char_matched")
    guided = vote.rank_candidates(vote.rank_weighted_votes(has(tops, "guided"), groups), top_k=top_k).select(
        "request_id", "group_id", "score", "votes", "rank", F.lit(None).cast("string").alias("char_matched"))
    candidates = cut_lineage(mixed.unionByName(guided))
    # Characters by the place of their candidate, then by their own; the list is bounded by the character set.
    used = (seen.join(every.select("request_id", "group_id", "rank"), ["request_id", "group_id"])
            .groupBy("request_id", "char").agg(F.min(F.struct("rank", "ord")).alias("at"))
            .groupBy(F.col("request_id").alias("image_id")).agg(
                F.transform(F.sort_array(F.collect_list(F.struct("at", "char"))), lambda c: c["char"]).alias("chars_used")))
    segments = free.join(cut_routes.select("line_id", "image_id"), "line_id").select("image_id", "line_id", "seg_no", "char", "top")
    best = candidates.filter(F.col("rank") == 1).select("request_id", "group_id", "score", "votes")
    verdicts = images.join(best, "request_id", "left").select(
        F.col("request_id").alias("image_id"), "outcome",
        S.verdict(F.col("score")).alias("verdict"),
        # The guided path reports a rounded confidence, the mixed path the plain mean.
        F.when(F.col("outcome") == "guided", F.round("score", 4)).otherwise(F.col("score")).alias("confidence"),
        F.col("group_id").alias("best_font"), F.coalesce("votes", F.lit(0)).alias("votes"),
        F.when(F.col("score").isNull(), NOTHING_COMPARED).alias("note"),
    ).fillna(0.0, ["confidence"])
    if fonts is not None:
        candidates = catalog.with_metadata(candidates, fonts)
    return {"lines": cut_routes, "candidates": candidates.withColumnRenamed("request_id", "image_id"),
            "segments": segments, "chars_used": used, "images": verdicts}


def whole_image_lines(images: DataFrame) -> DataFrame:
    """Images in which nothing was detected, as one untrusted line over the whole image each."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    return images.select(
        "image_id", F.concat(F.lit("whole-"), F.col("image_id").cast("string")).alias("line_id"),
        F.lit(0).alias("line_no"), "height", "width", "px", F.lit("").alias("text"), F.lit(0.0).alias("score"),
        F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h)).alias("box"))


def blank_images(images: DataFrame) -> DataFrame:
    """Images without any ink, which are answered with an error instead of a verdict."""
    inked = with_ink(images).select("image_id")
    return images.select("image_id").join(inked, "image_id", "left_anti").withColumn(
        "error", F.lit("no text found in the image"))
