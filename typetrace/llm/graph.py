"""Connected components of a link table, by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (least node reachable) of every node of ``links`` (``a``, ``b``, numbers).

    Each round takes the least label of the neighbours and then the label's own label, so paths
    halve. Labels combine before the shuffle; every round is written to the shared folder.
    """
    edges = stored(links.select("a", "b").filter("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        closer = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("closer"))
        step = closer.select("node", "label", "closer")
        jump = labels.select(F.col("node").alias("closer"), F.col("label").alias("jump"))
        moved = stored(step.join(jump, "closer", "left").select("node", F.col("label").alias("old"), F.least("closer", F.coalesce("jump", "closer")).alias("label")), "labels")
        done = moved.filter("old <> label").isEmpty()
        labels = moved.select("node", "label")
        if done:
            return labels
