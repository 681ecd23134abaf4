"""A training corpus from ``documents``, stage by stage.

Every stage takes the rows that the one before has kept, written as Parquet and read again, and its
decisions take effect: toxic documents go, one of each group of equal texts and of each component of
near-duplicates stays, sources are mixed to their targets (documents leave or repeat), and what is
left is encoded. All stages but the last return the columns of ``documents``.

Null texts count as empty; an empty table passes through; extra columns are kept until the last stage, whatever their names.
Of equal texts the row with the largest id stays, of near copies the one with the least; a row that is there twice, with its id,
counts as one of its group each time. Every stage first releases what the ones before have left on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typetrace.llm import exact_dedup, minhash, mixing, sentencepieces, toxicity
from typetrace.llm.common import crc_bucket, release, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on four fifths of the labelled ones among them, does not call toxic."""
    release(spark)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), learn=lambda i: crc_bucket(i, 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest id of each group of equal texts."""
    release(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component over five-word shingles at 0.8."""
    release(spark)
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    release(spark)
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they give it back."""
    release(spark)
    return sentencepieces.encoded_and_decoded(docs, sentencepieces.read_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# Fitted scores, MinHash and hashed draws have no twin in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
