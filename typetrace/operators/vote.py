"""Evidence combination: rank-weighted votes, counted votes, floors and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from typetrace.functions import scores as S


def with_group(df: DataFrame, groups: DataFrame, font: str = "font_id") -> DataFrame:
    """Map each font to the representative of its same-source group, itself when it has none."""
    g = groups.select(F.col("font_id").alias(font), F.col("group_id").alias("_rep"))
    return (
        df.join(g, font, "left")
        .withColumn("group_id", F.coalesce("_rep", font))
        .drop("_rep")
    )


def rank_weight(score, rank, decay: float = S.RANK_DECAY):
    """Weight of a candidate at 0-based ``rank`` in the short list of its character."""
    return score * (1.0 - decay * rank)


def rank_weighted_votes(
    tops: DataFrame, groups: DataFrame, decay: float = S.RANK_DECAY, one_vote_per_group: bool = False
) -> DataFrame:
    """``tops(request_id, mark_id, font_id, rank, score)`` to mean weight and votes per group.

    The mean runs over the characters a group was seen for, so absence is not punished. Two
    members of one group in one short list both count, unless ``one_vote_per_group``.
    """
    votes = with_group(tops, groups).withColumn("w", rank_weight(F.col("score"), F.col("rank"), decay))
    if one_vote_per_group:
        votes = votes.groupBy("request_id", "mark_id", "group_id").agg(F.max("w").alias("w"))
    return votes.groupBy("request_id", "group_id").agg(
        F.avg("w").alias("score"), F.count("w").alias("votes")
    )


def rank_candidates(
    voted: DataFrame, min_score: float | None = S.MIN_VALID, top_k: int | None = S.TOP_K, by_votes: bool = False
) -> DataFrame:
    """Order the groups of a request and keep the first ``top_k`` (all for None).

    The manual rule drops groups under the floor after aggregation and sorts by score; the
    automatic rule has no floor here and lets the number of votes decide first.
    """
    if min_score is not None:
        voted = voted.filter(F.col("score") >= min_score)
    order = [F.desc("score"), F.asc("group_id")]
    if by_votes:
        order = [F.desc("votes"), *order]
    w = W.partitionBy("request_id").orderBy(*order)
    ranked = voted.withColumn("rank", F.row_number().over(w))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def request_verdicts(
    marks: DataFrame, candidates: DataFrame, free_from: float = S.FREE_FROM, suspect_from: float = S.SUSPECT_FROM
) -> DataFrame:
    """One row per request of ``marks``; a request without candidates is ``unknown``."""
    best = candidates.filter(F.col("rank") == 1).select(
        "request_id", F.col("group_id").alias("best_font"), "score", "votes"
    )
    return (
        marks.select("request_id").distinct()
        .join(best, "request_id", "left")
        .select(
            "request_id",
            S.verdict(F.col("score"), free_from, suspect_from).alias("verdict"),
            F.coalesce(F.round("score", 4), F.lit(0.0)).alias("confidence"),
            "best_font",
            F.coalesce("votes", F.lit(0)).alias("votes"),
        )
    )


def merge_votes(*tables: DataFrame) -> DataFrame:
    """Partial vote tables are concatenated before they are averaged; means are never merged."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t)
    return merged


def counted_votes(seen: DataFrame) -> DataFrame:
    """``seen(request_id, group_id, score, char, ord)`` to count, mean and first-seen character."""
    return seen.groupBy("request_id", "group_id").agg(
        F.avg("score").alias("score"),
        F.count("*").alias("votes"),
        F.min_by("char", "ord").alias("char_matched"),
        F.min("ord").alias("first_seen"),
    )
