"""Per-request reports: evidence rows, shares, disagreements, legends and box hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from typetrace.functions import scores as S
from typetrace.operators.catalog import with_metadata
from typetrace.operators.vote import with_group


def evidence(marks: DataFrame, tops: DataFrame, groups: DataFrame, fonts: DataFrame) -> DataFrame:
    """One row per mark with its short list; a mark without candidates keeps an empty list."""
    named = with_metadata(with_group(tops, groups), fonts)
    item = F.struct("rank", F.col("group_id").alias("font_id"), "name", F.round("score", 4).alias("score"))
    lists = named.groupBy("mark_id").agg(F.sort_array(F.collect_list(item)).alias("top"))
    return marks.select("request_id", "mark_id", "char").join(lists, "mark_id", "left").withColumn(
        "top", F.coalesce("top", F.array().cast(lists.schema["top"].dataType))
    )


def request_report(verdicts: DataFrame, candidates: DataFrame, fonts: DataFrame) -> DataFrame:
    """Verdict and nested candidates with metadata, at most ``top_k`` per request.

    The evidence of its marks stays a table of its own (``evidence``) or goes along page by page
    (``paged_report``), because a request may hold any number of marks.
    """
    item = F.struct("rank", F.col("group_id").alias("font_id"), "name", "license", "source_url",
                    F.round("score", 4).alias("score"), "votes")
    cands = with_metadata(candidates, fonts).groupBy("request_id").agg(
        F.sort_array(F.collect_list(item)).alias("candidates"))
    return verdicts.join(cands, "request_id", "left")


PAGE = 1000


def paged_report(report: DataFrame, evidence: DataFrame, place: str = "mark_id", page: int = PAGE) -> DataFrame:
    """``request_report`` with the evidence of its marks nested in their order under ``per_char``, a row for each ``page``.

    A page holds the marks whose whole number ``place``, distinct within a request, falls into one span of ``page``, so no
    row grows with its request and no task holds a long one. A request without marks has one row, page 0 and an empty list.
    """
    mark = F.struct(F.col(place).alias("place"), "char", "top")
    pages = evidence.groupBy("request_id", F.floor(F.col(place) / page).alias("page")).agg(F.sort_array(F.collect_list(mark)).alias("per_char"))
    return report.join(pages, "request_id", "left").withColumn("page", F.coalesce("page", F.lit(0))).withColumn(
        "per_char", F.coalesce("per_char", F.array().cast(pages.schema["per_char"].dataType)))


def shares(tops: DataFrame, first: int = 3) -> DataFrame:
    """Share of each of the first candidates in their sum; negatives count as 0."""
    w = W.partitionBy("mark_id")
    level = F.greatest("score", F.lit(0.0))
    total = F.sum(level).over(w)
    return tops.filter(F.col("rank") < first).withColumn(
        "share", level / F.when(total == 0, F.lit(1.0)).otherwise(total) * 100
    )


def disagreements(marks: DataFrame, tops: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Marks whose best font differs from the winner of their request."""
    best = with_group(tops.filter(F.col("rank") == 0), groups).select("request_id", "mark_id", "group_id")
    winner = candidates.filter(F.col("rank") == 1).select("request_id", F.col("group_id").alias("winner"))
    return (
        best.join(winner, "request_id")
        .filter(F.col("group_id") != F.col("winner"))
        .join(marks.select("mark_id", "char"), "mark_id")
    )


def first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values per key in the order of their first appearance."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("values")
    )


TILE = 64


def first_hit(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """First box in list order that holds a point of the same image, bounds included.

    Boxes sit on the tile level of their own size, where a box touches at most four tiles, and
    a point asks once on each level its image has. Equal boxes and points are folded before they meet.
    """
    edge = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log2(edge / F.lit(TILE)))).cast("int")
    size = TILE * F.pow(F.lit(2.0), F.col("level"))
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    placed = (
        boxes.groupBy("image_id", "x1", "y1", "x2", "y2").agg(F.min("seq").alias("seq"))
        .withColumn("level", level)
    )
    levels = placed.select("image_id", "level").distinct()
    placed = (
        placed.withColumn("tx", tiles("x1", "x2")).withColumn("ty", tiles("y1", "y2"))
    )
    asked = (
        points.select("image_id", "px", "py").distinct()
        .join(levels, "image_id")
        .withColumn("tx", F.floor(F.col("px") / size)).withColumn("ty", F.floor(F.col("py") / size))
    )
    inside = F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2"))
    hits = (
        asked.join(placed, ["image_id", "level", "tx", "ty"]).filter(inside)
        .groupBy("image_id", "px", "py").agg(F.min("seq").alias("hit"))
    )
    return points.join(hits, ["image_id", "px", "py"])
