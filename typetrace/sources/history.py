"""History of manual matches: one appended JSON line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from typetrace.schemas import HISTORY


def history_rows(results: DataFrame, ts: str = "ts", keep: list[str] | None = None) -> DataFrame:
    """``results(ts, chars, verdict, top, score)`` in the stored form, and columns to ``keep``."""
    return results.select(
        *(keep or []),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts"), "chars", "verdict",
        F.coalesce("top", F.lit("")).alias("top"), F.col("score").cast("double").alias("score"),
    )


def request_rows(marks: DataFrame, report: DataFrame, ts: str = "ts", place: str = "mark_id") -> DataFrame:
    """History of matched requests from their ``report`` (with ``ts``): characters in the order of the marks, repeats
    included, and the name of the first candidate. Every stored line holds its whole request, as its readers expect."""
    chars = F.transform(F.sort_array(F.collect_list(F.struct(place, "char"))), lambda m: m["char"])
    ordered = marks.groupBy("request_id").agg(chars.alias("chars"))
    best = F.get("candidates", F.lit(0))["name"]
    return history_rows(report.join(ordered, "request_id").withColumn("top", best).withColumn("score", F.col("confidence")), ts, ["request_id"])


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)
