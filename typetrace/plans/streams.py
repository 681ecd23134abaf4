"""Stream jobs fed from the given tables and run until the input is used up and closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from typetrace.functions import scores as S
from typetrace.operators import search
from typetrace.plans import fixtures as fx
from typetrace.plans.matching import _VOTE
from typetrace.plans.registry import query
from typetrace.session import scratch_folder
from typetrace.streaming import jobs as J


def _stream(spark, sf, name):
    """The table, a file or a folder of files, as a file stream. Only a pattern may name a single file."""
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _utc(ts: str):
    """Event time as an instant. The tables hold times without a zone, which are read as UTC."""
    return F.concat(F.col(ts).cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")


def _utc_text(instant: str):
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _history(spark, sf, closing):
    score = F.least(F.col("value") / 100, F.lit(1.0))
    rows = _stream(spark, sf, "events").select(
        _utc("ts").alias("ts"), "user_id", "event_id", score.alias("score"),
        S.verdict(score).alias("verdict"))
    return J.with_closing(rows, closing)


def _finished(df, spark, name, mode="append", closing=None):
    """Run a stream into a parquet folder, close its input where it has a closing folder, and read the result."""
    out, check = scratch_folder(spark, name), scratch_folder(spark, f"{name}-state")
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", out)
    if closing:
        J.run_to_end(writer, check, spark, closing)
    else:
        J.run_available(writer, check)
    return spark.read.schema(df.schema).parquet(out)


_EVENTS = """WITH h AS (SELECT ts, user_id, event_id, least(value / 100, 1) AS score FROM events),
e AS (SELECT *, CASE WHEN score >= 0.9 THEN 'free' WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict FROM h)
"""


@query("R3", _EVENTS + """
, b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s, verdict FROM e)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, verdict, count(*) AS n FROM b GROUP BY ALL""")
def verdicts_per_window(spark, sf):
    closing = scratch_folder(spark, "closing")
    rows = _finished(J.verdict_counts(_history(spark, sf, closing), "10 minutes", "6 hours"), spark, "tumbling", closing=closing)
    return rows.select(_utc_text("window.start").alias("start"), "verdict", "n")


@query("R3", _EVENTS + """
, b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - to_hours(6 * i) AS s, verdict FROM e, range(0, 2) r(i))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, verdict, count(*) AS n FROM b GROUP BY ALL""")
def verdicts_per_sliding_window(spark, sf):
    closing = scratch_folder(spark, "closing")
    rows = _finished(J.verdict_counts(_history(spark, sf, closing), "10 minutes", "12 hours", "6 hours"), spark, "sliding", closing=closing)
    return rows.select(_utc_text("window.start").alias("start"), "verdict", "n")


@query("R3", _EVENTS + """
, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS n FROM e),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n, max(score) AS best FROM s
GROUP BY user_id, k""")
def verdicts_per_session(spark, sf):
    closing = scratch_folder(spark, "closing")
    rows = _finished(J.verdict_sessions(_history(spark, sf, closing), "10 minutes", "3 hours", "user_id"), spark, "session", closing=closing)
    return rows.select("user_id", _utc_text("session_window.start").alias("start"), "n", "best")


@query("R1 S6", _VOTE + """
SELECT r.request_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'free'
            WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict,
       coalesce(round(score, 4), 0.0) AS score, coalesce(group_id::VARCHAR, '') AS top, 'abcde' AS chars
FROM (SELECT DISTINCT request_id FROM crop) r
LEFT JOIN cands c ON c.request_id = r.request_id AND c.rank = 1""")
def streamed_matches(spark, sf):
    base = fx.glyph_rows(_stream(spark, sf, "embeddings"))
    crops = search.with_features(fx.disturbed(base, fx.glyphs(spark, sf)), "field", fx.WORDS)
    index = fx.templates(spark, sf)
    out = scratch_folder(spark, "matches")
    writer = J.continuous_matching(
        crops, lambda batch: search.match_marks(batch, index, fx.WORDS, fx.SIDE), fx.groups(spark, sf), out)
    J.run_available(writer, scratch_folder(spark, "matches-state"))
    rows = spark.read.schema(
        "request_id bigint, ts string, chars array<string>, verdict string, top string, score double").json(out)
    return rows.select("request_id", "verdict", "score", "top", F.array_join("chars", "").alias("chars"))


@query("R2", """
WITH v AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS request_id, ts, length(event_type) % 4 AS font_id,
             (0.4::DOUBLE + value / 307) * (1 - 0.15::DOUBLE * (event_id % 5)) AS w FROM events),
g AS (SELECT request_id, CASE font_id WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE font_id END AS group_id, ts, w FROM v),
o AS (SELECT DISTINCT request_id FROM g),
a AS (SELECT request_id, group_id, avg(w) AS score, count(*) AS votes FROM g JOIN o USING (request_id) GROUP BY ALL),
b AS (SELECT * FROM a WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, group_id) = 1)
SELECT o.request_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'free' WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict,
       coalesce(round(score, 4), 0) AS confidence, group_id::BIGINT AS best_font, coalesce(votes, 0) AS votes
FROM o LEFT JOIN b USING (request_id)""")
def completed_requests(spark, sf):
    """Requests are a user's marks of one day."""
    e = _stream(spark, sf, "events")
    tops = e.select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("request_id"),
        _utc("ts").alias("ts"), (F.length("event_type") % 4).cast("bigint").alias("font_id"),
        (F.col("event_id") % 5).alias("rank"), (0.4 + F.col("value") / 307).alias("score"))
    closing = scratch_folder(spark, "closing")
    rows = J.request_completion(J.with_closing(tops, closing), fx.groups(spark, sf), "10 minutes", 3_600_000)
    return _finished(rows, spark, "requests", closing=closing)


@query("R1 R2", _VOTE + """
SELECT r.request_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'free'
            WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict,
       coalesce(round(score, 4), 0.0) AS confidence, group_id::BIGINT AS best_font
FROM (SELECT DISTINCT request_id FROM crop) r
LEFT JOIN cands c ON c.request_id = r.request_id AND c.rank = 1""")
def spread_requests(spark, sf):
    """Requests whose marks come in several batches, a character each: one verdict a request, when the input is closed."""
    # The files hold what arrives; features are worked out batch by batch, in as many tasks as a batch has.
    crops, index = fx.raw_crops(spark, sf).select("request_id", "mark_id", "char", "field"), fx.templates(spark, sf)
    parts, lists, closing = (scratch_folder(spark, n) for n in ("crop-files", "short-lists", "closing"))
    # One file of crops a character and one batch a file, so every request is cut.
    timed = crops.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.ascii("char")))
    timed.repartition(1).sortWithinPartitions("char").write.option("maxRecordsPerFile", max(1, -(-timed.count() // 3))).parquet(parts)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    match = lambda batch: search.match_marks(search.with_features(batch, "field", fx.WORDS), index, fx.WORDS, fx.SIDE)
    J.run_available(J.continuous_short_lists(stream, match, lists), scratch_folder(spark, "short-lists-state"))
    tops = J.with_closing(J.read_short_lists(spark, lists, dict(crops.dtypes)["request_id"]), closing)
    rows = J.request_completion(tops, fx.groups(spark, sf), "1 minute", 60_000)
    return _finished(rows, spark, "spread", closing=closing).drop("votes")


@query("R4", "SELECT DISTINCT user_id, event_type, floor(value)::BIGINT AS box FROM events")
def marks_without_repeats(spark, sf):
    """The allowed delay spans the whole table here, so every repeat is one."""
    marks = _stream(spark, sf, "events").select(
        _utc("ts").alias("ts"), "user_id", "event_type", F.floor("value").alias("box"))
    rows = J.without_repeats(marks, "3650 days", "user_id", "event_type", "box").drop("ts")
    return _finished(rows, spark, "repeats")


@query("R4 W9", """
SELECT user_id, event_type AS char, max(event_id) AS seq, arg_max(floor(value)::BIGINT, event_id) AS box
FROM events GROUP BY ALL""")
def latest_streamed_marks(spark, sf):
    marks = _stream(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("char"), F.col("event_id").alias("seq"), F.floor("value").alias("box"))
    out = scratch_folder(spark, "latest")
    J.run_available(J.latest_marks(marks, out, "user_id", "char"), scratch_folder(spark, "latest-state"))
    return J.read_latest_marks(spark, out, "user_id", "char")
