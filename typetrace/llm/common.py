"""Reading, storing and word rules shared by the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typetrace.session import cut_lineage

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: it survives lost executors and has no lineage behind it."""
    return cut_lineage(df, name)


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver, in Python and then in the JVM, for long chains of jobs.

    Spark's cleaner deletes the shuffles and broadcasts that nothing on the driver refers to any more only then.
    """
    gc.collect()
    spark._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """Remainder of crc32 of the id written as text; fixes which rows a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a higher-order function."""
    return F.transform(F.array(value), body)[0]
