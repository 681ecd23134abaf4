"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn=None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``y`` (mean label, 0 to 1) of distinct labelled texts, about ``rows`` labels at most.

    ``learn`` (a condition on the id) says which rows may be learnt from. The share of labels taken
    follows from their number, and a hash of the id decides, so a rerun takes the same. The
    labels taken are bounded by ``rows``, so they are broadcast and no text moves but theirs.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null")
    if learn is not None:
        given = given.filter(learn(F.col("id")))
    share = min(1.0, rows / max(1, given.count()))
    taken = given.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(taken), "id").groupBy("text").agg(F.avg("y").alias("y"))
