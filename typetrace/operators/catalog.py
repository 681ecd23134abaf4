"""Catalogue work: metadata joins, merges, keep-first and keep-latest, coverage, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from typetrace.operators.vote import with_group


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], latest: bool) -> DataFrame:
    """One whole row per key by an order, as an aggregate so that it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if latest else F.min_by
    return df.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return _pick(df, keys, order, latest=False)


def keep_latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return _pick(df, keys, order, latest=True)


def first_with_result(attempts: DataFrame, key: str, order: str, n_results: str) -> DataFrame:
    """First attempt, in order, that found anything; keys without one are absent."""
    return keep_first(attempts.filter(F.col(n_results) > 0), [key], F.col(order))


def preferred_member(members: DataFrame, key: str, name: str, pos: str, hint: str | None = None) -> DataFrame:
    """First member whose name holds ``regular`` or the key, else the first member.

    ``hint`` names the column that holds the text to look for when it is not the key itself.
    """
    plain = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit(""))
    wanted = F.replace(F.col(hint or key), F.lit("-"), F.lit(""))
    hit = F.contains(F.lower(name), F.lit("regular")) | F.contains(plain(name), wanted)
    return keep_first(members, [key], F.when(hit, 0).otherwise(1), F.col(pos))


def listing(fonts: DataFrame, groups: DataFrame) -> DataFrame:
    """First row in file order of every same-source group."""
    first = keep_first(with_group(fonts, groups), ["group_id"], F.col("file_pos"))
    return first.select("font_id", "name", "license", "style")


def with_metadata(df: DataFrame, fonts: DataFrame, font: str = "group_id") -> DataFrame:
    """Left join of font metadata: the name falls back to the id, the others to an empty text."""
    meta = fonts.select(F.col("font_id").alias(font), "name", "license", "source_url")
    return df.join(meta, font, "left").withColumns({
        "name": F.coalesce("name", F.col(font).cast("string")),
        "license": F.coalesce("license", F.lit("")),
        "source_url": F.coalesce("source_url", F.lit("")),
    })


def merge_catalogue(existing: DataFrame, found: DataFrame, key: str = "font_id") -> DataFrame:
    """Append the rows whose id is not there yet; existing rows are never changed."""
    return existing.unionByName(found.join(existing.select(key), key, "left_anti"))


def resolve_files(fonts: DataFrame, files: DataFrame) -> DataFrame:
    """Subset file where it exists, else the full file; system locators pass through.

    ``fonts(font_id, file, is_system)``, ``files(file, subset_path)``.
    """
    return fonts.join(files.select("file", "subset_path"), "file", "left").select(
        "font_id",
        F.when(F.col("is_system"), F.col("file"))
        .otherwise(F.coalesce("subset_path", F.concat(F.lit("files/"), "file"))).alias("path"),
    )


def required_chars(spark: SparkSession, text: str) -> DataFrame:
    """Distinct characters of a parameter text as a table."""
    return spark.range(1).select(F.explode(F.array_distinct(F.split(F.lit(text), ""))).alias("char"))


def coverage(
    fonts: DataFrame, available: DataFrame, required: DataFrame, key: Sequence[str], denominator: int | None = None
) -> DataFrame:
    """Share of the required characters each font has, with its tag.

    ``fonts(*key, exempt)``; fonts exempt from the check count as fully covered. The share is
    taken of the required characters there are, unless a fixed ``denominator`` is asked for.
    """
    hits = available.join(required, "char").groupBy(*key).agg(F.count("*").alias("hits"))
    total = F.lit(denominator) if denominator else required.agg(F.count("*")).scalar()
    share = F.when(F.col("exempt"), F.lit(1.0)).otherwise(F.col("hits") / total)
    return (
        fonts.join(hits, list(key), "left").fillna(0, ["hits"])
        .withColumn("ratio", share)
        .withColumn("tag", F.when(F.col("ratio") < 0.5, "FAIL").when(F.col("ratio") >= 0.9, "ok").otherwise("warn"))
    )


def missing_chars(fonts: DataFrame, available: DataFrame, required: DataFrame, key: Sequence[str]) -> DataFrame:
    """Required characters a font does not have. The required text is a parameter, so every
    font row carries it as one array; the difference needs no pairing of rows."""
    wanted = required.agg(F.sort_array(F.collect_list("char"))).scalar()
    have = available.join(required, "char").groupBy(*key).agg(F.collect_set("char").alias("have"))
    lacking = F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))
    return fonts.join(have, list(key), "left").select(*key, F.explode(lacking).alias("char"))


def subset_code_points(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct code points of all texts, with blank and line feed."""
    own = texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char")).filter(F.col("char") != "")
    extra = texts.sparkSession.range(1).select(F.explode(F.array(F.lit(" "), F.lit("\n"))).alias("char"))
    return own.distinct().union(extra).distinct().select(F.ascii("char").alias("code"))


def size_rollup(files: DataFrame, *keys: str) -> DataFrame:
    """``files(bytes_in, bytes_out, status)``: sizes, saving in percent and outcome counts."""
    done = F.col("status") == "ok"
    return files.groupBy(*keys).agg(
        F.sum("bytes_in").alias("bytes_in"),
        F.sum(F.when(done, F.col("bytes_out")).otherwise(0)).alias("bytes_out"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "skip", "fail")],
    ).withColumn("saved_percent", 100 * (1 - F.col("bytes_out") / F.col("bytes_in")))
