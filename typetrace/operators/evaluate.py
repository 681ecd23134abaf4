"""Accuracy of matches against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from typetrace.operators.vote import with_group


def request_hits(truth: DataFrame, candidates: DataFrame, groups: DataFrame, top_k: int | None = 5) -> DataFrame:
    """Per request: is the true group first, is it among the first ``top_k``, what was first.

    ``truth(request_id, true_font, mode)``. Truth and candidates are compared as groups.
    """
    t = with_group(truth, groups, "true_font").withColumnRenamed("group_id", "true_group")
    c = candidates.select("request_id", "group_id", "rank")
    same = F.col("group_id") == F.col("true_group")
    first = F.col("rank") == 1
    listed = F.lit(True) if top_k is None else F.col("rank") <= top_k
    return (
        t.join(c, "request_id", "left")
        .groupBy("request_id", "true_font", "mode")
        .agg(
            F.coalesce(F.max((same & first).cast("int")), F.lit(0)).alias("top1"),
            F.coalesce(F.max((same & listed).cast("int")), F.lit(0)).alias("top5"),
            F.max(F.when(first, F.col("group_id"))).alias("predicted"),
        )
    )


def accuracy(hits: DataFrame) -> DataFrame:
    """Overall, per mode and per font, in one pass."""
    return hits.groupingSets(
        [[], [F.col("mode")], [F.col("true_font")]], F.col("mode"), F.col("true_font")
    ).agg(
        F.count("*").alias("n"), F.sum("top1").alias("top1"), F.sum("top5").alias("top5"),
        F.avg("top1").alias("top1_rate"), F.avg("top5").alias("top5_rate"),
    )


def confusions(hits: DataFrame) -> DataFrame:
    """What came first where the truth is missing from the short list."""
    return hits.filter(F.col("top5") == 0).groupBy(
        "true_font", F.coalesce(F.col("predicted").cast("string"), F.lit("none")).alias("predicted")
    ).agg(F.count("*").alias("n"))


def weakest_fonts(hits: DataFrame, first: int = 6) -> DataFrame:
    per_font = hits.groupBy("true_font").agg(F.avg("top1").alias("rate"), F.count("*").alias("n"))
    return per_font.orderBy("rate", "true_font").limit(first)


def main_confusions(hits: DataFrame, first: int = 8) -> DataFrame:
    return confusions(hits).orderBy(F.desc("n"), "true_font", "predicted").limit(first)
