"""Stream jobs over crops, marks and the match history."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from typetrace.functions import scores as S
from typetrace.operators import vote
from typetrace.sources import history


# Event time of the row that closes an input. Every window, session and open request ends before it (pandas holds times up to 2262).
END = "2200-01-01 00:00:00Z"


def with_closing(rows: DataFrame, folder: str, ts: str = "ts") -> DataFrame:
    """``rows`` and a stream of closing markers from ``folder``: rows of nulls but for their event time.

    To be put before any watermark. A marker's own window or session never ends, so it is in no result.
    """
    spark = rows.sparkSession
    marker = spark.createDataFrame([], f"{ts} timestamp")
    marker.write.mode("append").parquet(folder)
    marks = spark.readStream.schema(marker.schema).parquet(folder)
    null = lambda f: F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name)
    return rows.unionByName(marks.select(*(null(f) for f in rows.schema)))


def close_input(spark: SparkSession, folder: str, ts: str = "ts") -> None:
    """Say that nothing will follow: the next run moves the watermark past all gaps. Later rows are late."""
    spark.range(1).select(F.lit(END).cast("timestamp").alias(ts)).write.mode("append").parquet(folder)


def run_to_end(writer, checkpoint: str, spark: SparkSession, folder: str) -> StreamingQuery:
    """Process what is there, then the closing marker, so that nothing stays open.

    A restart after either step goes on from the checkpoint; a second marker changes nothing.
    """
    run_available(writer, checkpoint)
    close_input(spark, folder)
    return run_available(writer, checkpoint)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a restart from the checkpoint goes on after it."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def continuous_matching(
    crops: DataFrame, match: Callable[[DataFrame], DataFrame], groups: DataFrame, path: str
):
    """Match every micro-batch of a crop stream against a static index and append the verdicts.

    ``match`` turns a batch of crops into short lists. Ranking needs whole groups, so it runs
    per batch, and the marks of a request have to arrive in one batch; ``continuous_short_lists``
    serves requests that are spread. A batch that is run again replaces its own part.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()   # matched, listed and described below
        try:
            cands = vote.rank_candidates(vote.rank_weighted_votes(match(batch), groups))
            verdicts = vote.request_verdicts(batch, cands)
            # Distinct characters, so the list is bounded by the character set.
            chars = batch.groupBy("request_id").agg(F.sort_array(F.collect_set("char")).alias("chars"))
            rows = verdicts.join(chars, "request_id").select(
                "request_id", F.current_timestamp().alias("ts"), "chars", "verdict",
                F.col("best_font").cast("string").alias("top"), F.col("confidence").alias("score"))
            lines = history.history_rows(rows.withColumn("top", F.coalesce("top", F.lit(""))), keep=["request_id"])
            lines.write.mode("overwrite").json(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return crops.writeStream.foreachBatch(on_batch)


SHORT_LISTS = "request_id {request}, ts timestamp, font_id bigint, rank int, score double"


def continuous_short_lists(crops: DataFrame, match: Callable[[DataFrame], DataFrame], path: str):
    """Short lists of every micro-batch, as files for ``request_completion``: a mark arrives whole, a request need not.

    ``crops`` has ``ts``, the event time of the mark. A mark without a candidate is a row without a font, so that its request
    is opened. A batch that is run again replaces its own part.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            tops = match(batch).select("mark_id", "font_id", "rank", "score")
            rows = batch.select("request_id", "mark_id", "ts").join(tops, "mark_id", "left").drop("mark_id")
            rows.withColumn("rank", F.col("rank").cast("int")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return crops.writeStream.foreachBatch(on_batch)


def read_short_lists(spark: SparkSession, path: str, request: str = "string") -> DataFrame:
    """The files of ``continuous_short_lists`` as a stream, batch by batch."""
    return spark.readStream.schema(SHORT_LISTS.format(request=request)).parquet(f"{path}/batch=*")


# Open requests of a bucket, and the votes of their groups; ``owners`` are places in ``requests``.
_STATE = ("requests array<{request}>, lasts array<bigint>, dues array<bigint>, "
          "owners array<int>, groups array<bigint>, sums array<double>, counts array<bigint>")
BUCKETS = 4096


def request_completion(tops: DataFrame, groups: DataFrame, delay: str, idle_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """Close a request once the watermark passes its last mark by ``idle_ms`` and judge it.

    ``tops(request_id, ts timestamp, font_id, rank, score)`` is a stream of short-list rows. State holds
    one sum and count per group of an open request. A mark later than that opens it anew. A row without a font
    only opens its request; one without a request is passed over.

    Requests are kept by bucket of their hash, so that one call judges many; a batch rewrites the open requests of the buckets it touches.
    ``buckets`` is part of a checkpoint.
    """
    request = dict(tops.dtypes)["request_id"]
    # A filter would go below the watermark and hide the closing marker from it, so rows without a request have a bucket.
    bucket = F.when(F.col("request_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int"))
    rows = vote.with_group(tops.withWatermark("ts", delay), groups).select(
        bucket.alias("bucket"), "request_id", "ts", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"),
        F.col("group_id").isNotNull().alias("voted"), F.coalesce("group_id", F.lit(0)).cast("bigint").alias("group_id"),
        vote.rank_weight(F.col("score"), F.col("rank")).cast("double").alias("w"))

    def judge(key, batches, state: GroupState):
        if key[0] < 0:
            return
        now = state.getCurrentWatermarkMs()
        names, last, due, owners, group, sums, counts = state.get if state.exists else ([],) * 7
        names = pd.Series(names, dtype=object)
        last, due = (pd.Series(v, index=names, dtype="int64") for v in (last, due))
        votes = pd.DataFrame({
            "request_id": names.to_numpy()[np.array(owners, dtype="int64")], "group_id": np.array(group, dtype="int64"),
            "w": np.array(sums, dtype="float64"), "n": np.array(counts, dtype="int64")})
        if not state.hasTimedOut:
            new = pd.concat(batches).astype({"request_id": object})
            seen = new.groupby("request_id")["ms"].max().clip(lower=0)
            last = pd.concat([last, seen]).groupby(level=0).max()
            due = due.reindex(last.index, fill_value=0)
            touched = last.index.isin(seen.index)
            due[touched] = np.maximum(last[touched] + idle_ms, now + 1)
            votes = pd.concat([votes, new.loc[new["voted"], ["request_id", "group_id", "w"]].assign(n=1)])
            votes = votes.groupby(["request_id", "group_id"], as_index=False).sum()
        over = due.to_numpy() < now
        owner = last.index.get_indexer(votes["request_id"])
        if over.any():
            mean = votes["w"] / votes["n"]
            valid = votes.assign(score=mean)[over[owner] & (mean >= S.MIN_VALID)]
            best = valid.sort_values(["score", "group_id"], ascending=[False, True]).drop_duplicates("request_id").set_index("request_id")
            best = best.astype({"group_id": "Int64"}).reindex(last.index[over])
            yield pd.DataFrame({
                "request_id": best.index, "score": best["score"].to_numpy(), "best_font": best["group_id"].array,
                "votes": best["n"].fillna(0).astype("int64").to_numpy()})
        if over.all():
            if state.exists:
                state.remove()
            return
        last, due, votes = last[~over], due[~over], votes[~over[owner]]
        state.update((
            last.index.tolist(), last.tolist(), due.tolist(), last.index.get_indexer(votes["request_id"]).tolist(),
            votes["group_id"].tolist(), votes["w"].tolist(), votes["n"].tolist()))
        state.setTimeoutTimestamp(int(due.min()))

    closed = rows.groupBy("bucket").applyInPandasWithState(
        judge, f"request_id {request}, score double, best_font bigint, votes bigint", _STATE.format(request=request), "append",
        GroupStateTimeout.EventTimeTimeout)
    return closed.select(
        "request_id", S.verdict(F.col("score")).alias("verdict"),
        F.coalesce(F.round("score", 4), F.lit(0.0)).alias("confidence"), "best_font", "votes")


def verdict_counts(rows: DataFrame, delay: str, length: str, slide: str | None = None) -> DataFrame:
    """Verdicts per tumbling or sliding window; rows later than ``delay`` are left out."""
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", length, slide or length), "verdict").agg(
        F.count("*").alias("n"))


def verdict_sessions(rows: DataFrame, delay: str, gap: str, key: str) -> DataFrame:
    """Matches per visit of a user, a visit ending after ``gap`` without a match."""
    return rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(
        F.count("*").alias("n"), F.max("score").alias("best"))


def without_repeats(marks: DataFrame, delay: str, *keys: str) -> DataFrame:
    """Drop exact repeats that arrive within ``delay`` of each other."""
    return marks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def latest_marks(marks: DataFrame, path: str, *keys: str, compact_every: int = 10, keep_seq: int | None = None):
    """Newest mark (largest ``seq``) per key, without state: a batch writes the newest of its own.

    After every ``compact_every`` batches the files so far become one snapshot, and those it holds are deleted, so the number of files
    is bounded. With ``keep_seq``, a snapshot leaves out keys whose newest mark lies that far behind the newest of all.
    A batch that is run again replaces its own part; a snapshot counts once it is whole.
    """
    spark = marks.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        _newest(batch, keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        now = read_latest_marks(spark, path, *keys)
        if keep_seq is not None:
            now = now.crossJoin(F.broadcast(now.agg((F.max("seq") - keep_seq).alias("least")))).filter("seq > least").drop("least")
        now.write.mode("overwrite").parquet(f"{path}/upto={batch_id}")
        for kind, number, place in _parts(spark, path):
            if number < batch_id or kind == "batch" and number == batch_id:
                place[0].delete(place[1], True)

    return marks.writeStream.foreachBatch(on_batch)


def _newest(rows: DataFrame, keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct("seq", "box"), "seq").alias("m")).select(*keys, "m.*")


def _parts(spark: SparkSession, path: str) -> list[tuple[str, int, tuple]]:
    """Whole parts of a folder of newest marks: kind, batch, and the place as Hadoop knows it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(root) if fs.exists(root) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind in ("batch", "upto") and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            out.append((kind, int(number), (fs, status.getPath())))
    return out


def read_latest_marks(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest mark of every key: the last whole snapshot and the batches after it."""
    parts = _parts(spark, path)
    last = max((n for kind, n, _ in parts if kind == "upto"), default=-1)
    places = [place[1].toString() for kind, n, place in parts if n > last or kind == "upto" and n == last]
    return _newest(spark.read.parquet(*places), keys)
