"""Limits that must not cut results, and random numbers that must not repeat."""

from pyspark.sql import functions as F

from typetrace.functions import noise, text as T
from typetrace.operators import evaluate, segment as G, vote
from typetrace.session import cut_lineage, spread


def test_no_limit_keeps_all_candidates(spark):
    voted = spark.range(40).select(F.lit(1).alias("request_id"), F.col("id").alias("group_id"), F.lit(0.9).alias("score"), F.lit(1).alias("votes"))
    assert vote.rank_candidates(voted).count() == 5
    every = vote.rank_candidates(voted, top_k=None)
    assert every.count() == 40
    truth = spark.createDataFrame([(1, 30, "m")], "request_id int, true_font long, mode string")
    groups = spark.createDataFrame([], "font_id long, group_id long")
    hits = lambda k: evaluate.request_hits(truth, every, groups, k).first().top5
    assert hits(5) == 0 and hits(None) == 1


def test_long_locators_are_whole(spark):
    path = "x" * 1_200_000
    got = spark.createDataFrame([(f"system:{path}#7",)], "l string").select(T.split_locator(F.col("l")).alias("p")).first().p
    assert got.path == path and got.member == 7


def test_no_two_glyphs_share_their_draws(spark):
    draws = [F.round(noise.uniform(noise.key(0, F.col("id"), slot)), 12).alias(f"d{slot}") for slot in range(3)]
    rows = spark.range(10_000).select(*draws).collect()
    values = [v for r in rows for v in r]
    assert len(set(values)) == len(values) and abs(sum(values) / len(values) - 0.5) < 0.01


def test_lines_are_split_in_full_or_given_up(spark):
    bounds = spark.createDataFrame([("a", 0, 2, 1, 9, 4), ("b", 3, 11, 1, 9, 4), ("c", 0, 5, 1, 9, 0)], "line_id string, x0 long, x1 long, y0 long, y1 long, n int")
    assert [(r.line_id, r.a, r.b, r.y0) for r in G.equal_split(bounds, "n").orderBy("part").collect()] == [("b", 3, 5, 1), ("b", 5, 7, 1), ("b", 7, 9, 1), ("b", 9, 11, 1)]


def test_spread_only_when_asked(spark):
    df = spark.range(10, numPartitions=1)
    old = spark.conf.get("spark.typetrace.spread")
    spark.conf.unset("spark.typetrace.spread")
    assert spread(df).rdd.getNumPartitions() == 1
    spark.conf.set("spark.typetrace.spread", old)
    assert spread(df).rdd.getNumPartitions() == int(old)


def test_stored_tables_prune_columns(spark):
    kept = cut_lineage(spark.range(5).selectExpr("id", "id * 2 AS wide"))
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and kept.count() == 5
