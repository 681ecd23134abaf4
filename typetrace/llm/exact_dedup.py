"""Exact deduplication by content-defined chunk recipes, in SQL functions only.

Texts are cut where their content says so: after at least ``least`` characters, at the next end of
sentence or line, and after ``most`` at the latest, so equal passages give equal chunks wherever
they stand once the cuts have met. Every distinct chunk crosses the network once and gets a verified
identifier: its hash, plus an ordinal if different chunks share that hash. From then on a document is
the ordered list of its identifiers, and lists, not texts, are grouped and compared.

Defined results: a null text counts as empty; the largest id of a group stays; null ids lose against
any id, and if a group has none but null ids, all its rows stay. A row repeated with its id is
returned as often as it was given, with the same verdict each time. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typetrace.llm.common import stored

LEAST, MOST = 512, 4096


def chunks_of(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Content-defined chunks of a text, in order; joined they are the text. Empty text: no chunk."""
    pattern = rf"(?s).{{1,{least}}}+[^.!?\n]{{0,{most - least}}}+[.!?\n]?+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def collided_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (``h``, ``chunk``) whose hash stands for several texts, each with its ordinal among them."""
    distinct = chunks.distinct()
    twice = distinct.groupBy("h").count().filter("count > 1").select("h")
    order = Window.partitionBy("h").orderBy("chunk")
    return distinct.join(twice, "h").withColumn("ordinal", F.row_number().over(order))


def recipes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_sha256``, ``recipe`` and ``marks``.

    ``recipe`` lists the chunk hashes in order; ``marks`` lists position and ordinal of the chunks
    whose hash is shared. Two rows agree in both if, and only if, their texts are equal.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    recipes = stored(texts.select(
        "doc_id",
        F.sha2(F.col("t"), 256).alias("text_sha256"),
        F.transform(chunks_of(F.col("t")), lambda c: chunk_hash(c)).alias("recipe"),
    ), "recipes")
    pieces = texts.select("doc_id", F.sha2(F.col("t"), 256).alias("text_sha256"), F.posexplode(chunks_of(F.col("t"))).alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk")))
    collided = stored(collided_chunks(pieces.select("h", "chunk")), "collided")
    none = F.array().cast("array<struct<pos:int,ordinal:int>>")
    if collided.isEmpty():
        return recipes.withColumn("marks", none)
    # The text's digest goes along with the id, since ids may repeat.
    marks = (pieces.join(collided, ["h", "chunk"]).select("doc_id", "text_sha256", "pos", "ordinal").distinct()
             .groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))).alias("marks")))
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.text_sha256") == F.col("m.text_sha256"))
    return recipes.alias("r").join(marks.alias("m"), same, "left").select("r.*", F.coalesce("m.marks", none).alias("marks"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash=F.xxhash64) -> DataFrame:
    """Verdict of every row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    recipes = recipes_of(docs, id_col, text_col, chunk_hash)
    # Only groups with several rows are joined back, so unique documents meet a small table; a hot
    # group is many rows on the left of an outer join, which adaptive execution splits.
    groups = (recipes.groupBy("recipe", "marks").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .filter("group_size > 1"))
    return (recipes.join(groups, ["recipe", "marks"], "left")
            .select("doc_id",
                    F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns."""
    out = exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(
        F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__gone")) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == F.col("__sha"))
    return docs.join(out, same, "left_anti")
