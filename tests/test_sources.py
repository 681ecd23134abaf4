"""Sources and sinks on small files, and text classes the given tables do not hold."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from png import write_png
from typetrace.functions import pixels as P, text as T
from typetrace.operators import catalog as C
from typetrace.plans import fixtures as fx
from typetrace.sources import catalog, history, images, index, lines


def test_catalogue_and_manifest(spark, tmp_path):
    rows = [{"id": f"f{i}", "name": f"n{i}", "license": "OFL", "commercial_free": True, "file": "x.ttf"} for i in (3, 1, 2)]
    (tmp_path / "fonts.json").write_text(json.dumps(rows, indent=1))
    got = catalog.read_catalogue(spark, str(tmp_path / "fonts.json")).orderBy("file_pos").collect()
    assert [r.id for r in got] == ["f3", "f1", "f2"] and got[0].is_system is None
    (tmp_path / "list.txt").write_text("# note\n\na: http://x/1: 2\nb: u\n  a: http://y \n")
    assert {r.font_id: r.url for r in catalog.read_manifest(spark, str(tmp_path / "list.txt")).collect()} == {
        "a": "http://y", "b": "u"}


def test_image_files_and_payloads(spark, tmp_path):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rgb = np.stack([gray, gray + 50, gray + 100], axis=2)
    write_png(tmp_path / "g.png", gray)
    write_png(tmp_path / "c.png", rgb)
    (tmp_path / "broken.png").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path))
    rows = {r.origin.rsplit("/", 1)[1]: r for r in read.collect()}
    assert rows["broken.png"].error and rows["broken.png"].px is None and rows["g.png"].error is None
    mean = read.filter("error IS NULL").select("origin", P.gray_array(images.levels(F.col("px")), F.col("channels")).alias("gray")).collect()
    got = {r.origin.rsplit("/", 1)[1]: r.gray for r in mean}
    assert got["g.png"] == gray.ravel().tolist() and got["c.png"] == (gray + 50).ravel().tolist()
    assert bytes(rows["g.png"].px) == gray.tobytes() and rows["g.png"].channels == 1
    assert bytes(rows["c.png"].px) == rgb[:, :, ::-1].tobytes() and rows["c.png"].channels == 3
    df = spark.createDataFrame([(base64.b64encode(gray.tobytes()).decode(),)], "p string")
    assert bytes(df.select(images.from_base64(F.col("p")).alias("px")).first().px) == gray.tobytes()


def test_index_round_trip_and_missing_index(spark, tmp_path):
    t = fx.templates(spark, "/root/testdata/sf0.001").select("font_id", "char", "words")
    index.write_index(t, str(tmp_path / "index"))
    back = index.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(str, back.collect())) == sorted(map(str, t.collect()))
    plan = back.filter("char = 'b'").select("font_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(char), EqualTo(char,b)]" in plan and "words" not in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.read_index(spark, str(tmp_path / "none"))


def test_history_appends(spark, tmp_path):
    one = spark.sql("SELECT timestamp'2024-05-06 07:08:09' AS ts, array('a','b') AS chars, 'free' AS verdict, "
                    "CAST(NULL AS string) AS top, 0.9 AS score")
    for _ in range(2):
        history.append_history(history.history_rows(one), str(tmp_path / "h"))
    got = history.read_history(spark, str(tmp_path / "h")).collect()
    assert len(got) == 2 and got[0].asDict() == {
        "ts": "2024-05-06 07:08:09", "chars": ["a", "b"], "verdict": "free", "top": "", "score": 0.9}


def test_coverage_report_and_denominator(spark, tmp_path):
    fonts = spark.createDataFrame([("x", False), ("y", False), ("z", True)], "f string, exempt boolean")
    have = spark.createDataFrame([("x", c) for c in "abcdefghi"] + [("y", "a")], "f string, char string")
    need = C.required_chars(spark, "abcdefghijaa")
    got = {r.f: (r.hits, round(r.ratio, 3), r.tag) for r in C.coverage(fonts, have, need, ["f"]).collect()}
    assert got == {"x": (9, 0.9, "ok"), "y": (1, 0.1, "FAIL"), "z": (0, 1.0, "ok")}
    fixed = {r.f: r.ratio for r in C.coverage(fonts, have, need, ["f"], denominator=5).collect()}
    assert fixed["x"] == 1.8
    catalog.write_coverage(C.coverage(fonts, have, need, ["f"]), str(tmp_path / "cov"))
    assert spark.read.json(str(tmp_path / "cov")).count() == 3
    lacking = {(r.f, r.char) for r in C.missing_chars(fonts, have, need, ["f"]).collect()}
    assert ("x", "j") in lacking and len(lacking) == 1 + 9 + 10


def test_text_classes(spark):
    df = spark.createDataFrame([("½９，锋a😀_é-7",), ("，。",)], "t string")
    got = [r.u for r in df.select(T.usable_chars(F.col("t")).alias("u")).collect()]
    assert got == [["½", "９", "锋", "a", "é", "7"], []]
    names = {"Noto Sans Serif": "serif", "My Light": "li", "XX Mono Serif": "mono", "苹方 SC": "sans",
             "Plain": "mixed", "楷体": "serif", "Handy": "kai"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.guess_style(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == names
    buckets = spark.createDataFrame([("source-han-sans",), ("锋",), ("",)], "k string").select(
        "k", T.colour_bucket(F.col("k")).alias("b")).collect()
    for r in buckets:
        h = 0
        for i in range(0, len(r.k.encode("utf-16-be")), 2):
            h = (h * 31 + int.from_bytes(r.k.encode("utf-16-be")[i:i + 2], "big")) & 0xFFFFFFFF
        h = h - 2 ** 32 if h >= 2 ** 31 else h
        assert r.b == abs(h) % 10
    loc = spark.createDataFrame([("system:/a/b.ttc#3",), ("x.ttf",)], "l string").select(T.split_locator(F.col("l")).alias("p"))
    assert [tuple(r.p) for r in loc.collect()] == [("/a/b.ttc", 3), ("x.ttf", None)]
    files = spark.createDataFrame([("SF-Pro.ttf", ".ttf"), ("a.TTC", ".TTC"), ("b.txt", ".txt")], "f string, e string")
    assert [r.f for r in files.filter(T.scannable_file(F.col("f"), F.col("e"))).collect()] == ["a.TTC"]


def test_incomplete_lines_are_dropped(spark):
    p = (1.0, 2.0)
    rows = [(1, [p, p, p, p], "a", 0.5), (2, None, "a", 0.5), (3, [p, None, p, p], "a", 0.5),
            (4, [p] * 4, None, 0.5), (5, [p] * 4, "a", None), (6, [], "a", 0.5)]
    df = spark.createDataFrame(rows, "i int, box array<struct<x double, y double>>, text string, score double")
    assert [r.i for r in lines.complete_lines(df).collect()] == [1]
