"""Streams over several batches: same answer as one batch, late rows, state that closes."""

from pyspark.sql import functions as F

from typetrace.streaming import jobs as J


def feed(spark, folder, schema, *batches):
    """One file per batch, in order."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return df.withColumn("ts", F.to_timestamp("ts"))


def finish(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    J.run_available(df.writeStream.format("parquet").outputMode(mode).option("path", out), str(tmp_path / "check"))
    return df.sparkSession.read.schema(df.schema).parquet(out).collect()


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    s = feed(spark, tmp_path / "in", "ts string, verdict string",
             [("2024-01-01 00:01:00", "free"), ("2024-01-01 01:30:00", "free")],
             [("2024-01-01 01:25:00", "risky")],
             [("2024-01-01 00:02:00", "free"), ("2024-01-01 05:00:00", "free")])
    got = {(str(r.window.start), r.verdict): r.n for r in finish(J.verdict_counts(s, "10 minutes", "1 hour"), tmp_path)}
    assert got == {("2024-01-01 00:00:00", "free"): 1, ("2024-01-01 01:00:00", "free"): 1,
                   ("2024-01-01 01:00:00", "risky"): 1}


def test_request_spread_over_batches_closes_once(spark, tmp_path):
    groups = spark.createDataFrame([(0, 0), (1, 0)], "font_id bigint, group_id bigint")
    row = lambda r, t, f, k, s: (r, f"2024-01-01 00:{t:02d}:00", f, k, s)
    s = feed(spark, tmp_path / "in", "request_id string, ts string, font_id bigint, rank int, score double",
             [row("a", 0, 1, 0, 0.95), row("a", 0, 7, 1, 0.9), row("b", 1, 7, 0, 0.3)],
             [row("a", 2, 0, 0, 0.93)],
             [row("c", 40, 5, 0, 0.8)])
    got = {r.request_id: r for r in finish(J.request_completion(s, groups, "1 minute", 300_000), tmp_path)}
    assert set(got) == {"a", "b"}
    assert (got["a"].best_font, got["a"].votes, got["a"].confidence, got["a"].verdict) == (0, 2, 0.94, "free")
    assert (got["b"].verdict, got["b"].best_font, got["b"].confidence) == ("unknown", None, 0.0)


def test_closed_input_leaves_nothing_open(spark, tmp_path):
    """Open windows, sessions and requests come out once the input is closed, also after a restart in between."""
    schema, closing = "ts string, user int, verdict string, score double", str(tmp_path / "closing")
    s = feed(spark, tmp_path / "in", schema, [("2024-01-01 00:01:00", 1, "free", 0.9)], [("2024-01-01 01:30:00", 1, "free", 0.8), ("2024-01-01 01:31:00", 2, "risky", 0.3)])
    cases = {"windows": J.verdict_counts(J.with_closing(s, closing), "10 minutes", "1 hour"),
             "sessions": J.verdict_sessions(J.with_closing(s, closing), "10 minutes", "1 hour", "user")}
    writer = {n: df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / n)) for n, df in cases.items()}
    read = lambda n: spark.read.schema(cases[n].schema).parquet(str(tmp_path / n)).collect()
    for n in cases:
        J.run_available(writer[n], str(tmp_path / f"{n}-check"))
    assert len(read("windows")) == 1 and len(read("sessions")) == 1
    J.close_input(spark, closing)
    for n in cases:
        J.run_available(writer[n], str(tmp_path / f"{n}-check"))
    assert sorted((str(r.window.start), r.verdict, r.n) for r in read("windows")) == [
        ("2024-01-01 00:00:00", "free", 1), ("2024-01-01 01:00:00", "free", 1), ("2024-01-01 01:00:00", "risky", 1)]
    assert sorted((r.user, r.n) for r in read("sessions")) == [(1, 1), (1, 1), (2, 1)]
    J.close_input(spark, closing)
    J.run_available(writer["windows"], str(tmp_path / "windows-check"))
    assert len(read("windows")) == 3


def test_open_requests_survive_a_restart(spark, tmp_path):
    groups = spark.createDataFrame([(0, 0)], "font_id bigint, group_id bigint")
    closing, schema = str(tmp_path / "closing"), "request_id string, ts string, font_id bigint, rank int, score double"
    s = feed(spark, tmp_path / "in", schema, [("a", "2024-01-01 00:00:00", 5, 0, 0.95), ("n", "2024-01-01 00:00:00", None, None, None)])
    done = J.request_completion(J.with_closing(s, closing), groups, "1 minute", 300_000)
    writer = done.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
    J.run_available(writer, str(tmp_path / "check"))
    feed(spark, tmp_path / "in", schema, [("a", "2024-01-01 00:02:00", 5, 0, 0.75), (None, "2024-01-01 00:02:00", 5, 0, 0.5)])
    J.run_to_end(writer, str(tmp_path / "check"), spark, closing)
    got = {r.request_id: (r.verdict, r.confidence, r.best_font, r.votes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("suspect", 0.85, 5, 2), "n": ("unknown", 0.0, None, 0)}


def test_requests_of_a_bucket_close_one_by_one(spark, tmp_path):
    """Few buckets hold many requests: each closes at its own time, opens anew after that, and keeps its own votes."""
    far = 2 ** 60 + 1
    groups = spark.createDataFrame([(1, 0), (far, far)], "font_id bigint, group_id bigint")
    schema, closing = "request_id string, ts string, font_id bigint, rank int, score double", str(tmp_path / "closing")
    row = lambda r, t, f, s: (r, f"2024-01-01 {t}:00", f, 0, s)
    first = [row(f"r{i}", "00:00", far if i % 2 else 1, 0.6 + i / 1000) for i in range(200)]
    first += [row("r3", "00:01", 1, 0.7), row("r4", "00:01", None, None), row("none", "00:00", None, None), row(None, "00:00", 1, 0.9)]
    s = feed(spark, tmp_path / "in", schema, first, [row("open", "00:30", 1, 0.8), row("r3", "00:30", 7, 0.95)],
             [row("x", "03:00", 1, 0.8)], [row("y", "04:00", 1, 0.8)], [row("r3", "05:00", 1, 0.8)])
    for buckets in (1, 3):
        out, check = str(tmp_path / f"out-{buckets}"), str(tmp_path / f"check-{buckets}")
        done = J.request_completion(J.with_closing(s, f"{closing}-{buckets}"), groups, "1 minute", 3_600_000, buckets=buckets)
        J.run_to_end(done.writeStream.format("parquet").outputMode("append").option("path", out), check, spark, f"{closing}-{buckets}")
        got = sorted((r.request_id, r.best_font, r.confidence, r.votes) for r in spark.read.parquet(out).filter("request_id <> 'none'").collect())
        want = [(f"r{i}", far if i % 2 else 0, round(0.6 + i / 1000, 4), 1) for i in range(200) if i != 3]
        assert got == sorted(want + [(r, 0, 0.8, 1) for r in ("open", "x", "y", "r3")] + [("r3", 7, 0.95, 1)])
        assert [(r.verdict, r.best_font, r.votes) for r in spark.read.parquet(out).filter("request_id = 'none'").collect()] == [("unknown", None, 0)]


def test_latest_marks_stay_few_files(spark, tmp_path):
    """Twenty batches: the files stay few, old keys go, and batches and snapshots run again change nothing."""
    schema = "ts string, user int, char string, seq int, box int"
    batches = [[("2024-01-01 00:00:00", u, "a", 10 * k + u, k) for u in range(3 if k < 5 else 2)] for k in range(20)]
    s = feed(spark, tmp_path / "in", schema, *batches)
    out = tmp_path / "latest"
    J.run_available(J.latest_marks(s, str(out), "user", "char", compact_every=4, keep_seq=100), str(tmp_path / "check"))
    got = {r.user: (r.seq, r.box) for r in J.read_latest_marks(spark, str(out), "user", "char").collect()}
    assert got == {0: (190, 19), 1: (191, 19)}
    assert sorted(p.name for p in out.iterdir()) == ["upto=19"]
    (out / "upto=23").mkdir()   # a snapshot that was begun and not ended
    assert {r.user for r in J.read_latest_marks(spark, str(out), "user", "char").collect()} == {0, 1}


def test_repeats_and_latest_marks(spark, tmp_path):
    schema = "ts string, user int, char string, seq int, box int"
    batches = [
        [("2024-01-01 00:00:00", 1, "a", 1, 10), ("2024-01-01 00:00:01", 1, "a", 2, 20)],
        [("2024-01-01 00:00:02", 1, "a", 1, 10), ("2024-01-01 00:00:03", 1, "b", 3, 30)],
    ]
    s = feed(spark, tmp_path / "in", schema, *batches)
    assert sorted((r.seq, r.box) for r in finish(J.without_repeats(s, "1 hour", "user", "char", "seq", "box"), tmp_path)) == [
        (1, 10), (2, 20), (3, 30)]
    out = str(tmp_path / "latest")
    J.run_available(J.latest_marks(s, out, "user", "char"), str(tmp_path / "check2"))
    got = {(r.user, r.char): (r.seq, r.box) for r in J.read_latest_marks(spark, out, "user", "char").collect()}
    assert got == {(1, "a"): (2, 20), (1, "b"): (3, 30)}


def test_tables_stream_from_a_file_and_from_a_folder(spark, tmp_path):
    import shutil

    from typetrace.plans import streams

    rows = spark.range(7).withColumnRenamed("id", "vec_id").coalesce(1)
    rows.write.parquet(f"{tmp_path}/two/embeddings.parquet")
    rows.write.parquet(f"{tmp_path}/two/other.parquet")
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "two" / "embeddings.parquet").glob("part-*.parquet")), tmp_path / "one" / "embeddings.parquet")
    for kind in ("one", "two"):
        got = finish(streams._stream(spark, f"{tmp_path}/{kind}", "embeddings"), tmp_path / f"run-{kind}")
        assert sorted(r.vec_id for r in got) == list(range(7))
