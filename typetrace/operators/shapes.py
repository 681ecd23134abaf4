"""Pixel tables ``(image_id, y, x)`` of ink and point tables ``(shape_id, seq, x, y)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from typetrace.operators import segment as G
from typetrace.session import cut_lineage


def rotate(pixels: DataFrame, height: int, width: int, quarter_turns: int) -> DataFrame:
    """Clockwise quarter turns of pixel coordinates."""
    y, x = F.col("y"), F.col("x")
    ny, nx = {0: (y, x), 1: (x, height - 1 - y), 2: (height - 1 - y, width - 1 - x),
              3: (width - 1 - x, y)}[quarter_turns % 4]
    return pixels.withColumns({"y": ny, "x": nx})


def dilate(ink: DataFrame, height: int, width: int, kernel: int) -> DataFrame:
    """Ink grown by a square kernel, nothing coming in over the border."""
    reach = [F.lit(d) for d in range(-(kernel // 2), kernel - kernel // 2)]
    return (
        ink.select("image_id", "y", "x", F.explode(F.array(*reach)).alias("dy"))
        .select("image_id", (F.col("y") - F.col("dy")).alias("y"), "x")
        .filter(F.col("y").between(0, height - 1))
        .select("image_id", "y", "x", F.explode(F.array(*reach)).alias("dx"))
        .select("image_id", "y", (F.col("x") - F.col("dx")).alias("x"))
        .filter(F.col("x").between(0, width - 1))
        .distinct()
    )


def components(ink: DataFrame) -> DataFrame:
    """4-neighbour components: adds ``component``, the smallest run key of the component.

    Rows of ink become runs, runs that touch in adjacent rows become edges, and labels spread
    by taking the smallest neighbour label and then the label of one's label. Each round is
    stored before the next. Labels only ever fall, so rounds end, when none changes.
    """
    columns = ink.select(
        F.struct("image_id", "y").alias("line_id"), "x", F.lit(0).alias("y0"), F.lit(0).alias("y1"))
    runs = G.column_runs(columns).select(
        "line_id.image_id", "line_id.y", "x0", "x1",
        (F.shiftleft(F.col("line_id.y").cast("bigint"), 32) + F.col("x0")).alias("rid"))
    runs = cut_lineage(runs)
    a = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"),
                    F.col("rid").alias("other"))
    touching = runs.join(a, ["image_id", "y"]).filter((F.col("x0") < F.col("a1")) & (F.col("a0") < F.col("x1")))
    edges = touching.select("image_id", F.inline(F.array(
        F.struct(F.col("rid").alias("src"), F.col("other").alias("dst")),
        F.struct(F.col("other").alias("src"), F.col("rid").alias("dst")))))
    edges = cut_lineage(edges)
    labels = runs.select("image_id", "rid", F.col("rid").alias("label"))
    moving = True
    while moving:
        near = (
            edges.join(labels.select("image_id", F.col("rid").alias("dst"), "label"), ["image_id", "dst"])
            .groupBy("image_id", F.col("src").alias("rid")).agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, ["image_id", "rid"], "left").select(
            "image_id", "rid", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        parent = hooked.select("image_id", F.col("rid").alias("label"), F.col("label").alias("up"))
        jumped = cut_lineage(hooked.join(parent, ["image_id", "label"]).select(
            "image_id", "rid", "before", F.least("label", "up").alias("label")))
        moving = not jumped.filter(F.col("label") != F.col("before")).isEmpty()
        labels = jumped.drop("before")
    named = runs.join(labels.select("image_id", "rid", F.col("label").alias("component")), ["image_id", "rid"])
    return named.select("image_id", "y", "component", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def component_contours(labelled: DataFrame) -> DataFrame:
    """A component's own pixels stand for its contour: size and bounding rectangle."""
    return labelled.groupBy("image_id", "component").agg(F.count("*").alias("n"), *_rectangle())


def _rectangle():
    return (F.min("x").alias("x"), F.min("y").alias("y"),
            (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))


def bounding_rectangles(points: DataFrame) -> DataFrame:
    """Width and height are differences of coordinates, without an extra pixel."""
    return points.groupBy("shape_id").agg(*_rectangle())


def _edges(points: DataFrame) -> DataFrame:
    """Each point with the one after it. Points are numbered without gaps, so the pairing is an
    equi-join on shape and number, and a shape of very many points is spread over tasks."""
    after = points.select("shape_id", (F.col("seq") - 1).alias("seq"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return points.join(after, ["shape_id", "seq"], "left")


def _ends():
    """First and last point of a shape as aggregates."""
    return (F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("z"))


def polygon_areas(points: DataFrame) -> DataFrame:
    """Unsigned shoelace area, 0 below three points."""
    cross = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    sums = _edges(points).groupBy("shape_id").agg(F.count("*").alias("n"), cross.alias("open"), *_ends())
    closing = F.col("z.x") * F.col("a.y") - F.col("a.x") * F.col("z.y")
    area = F.when(F.col("n") >= 3, F.abs(F.col("open") + closing) / 2).otherwise(0.0)
    return sums.select("shape_id", area.alias("area"))


def polyline_lengths(points: DataFrame, closed: bool) -> DataFrame:
    """Length along the points, with the edge back to the first one when closed; 0 for one point."""
    step = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    sums = _edges(points).groupBy("shape_id").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("open"), *_ends())
    back = F.hypot(F.col("a.x") - F.col("z.x"), F.col("a.y") - F.col("z.y")) if closed else F.lit(0.0)
    return sums.select("shape_id", (F.col("open") + back).alias("length"))
