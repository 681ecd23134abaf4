"""Components, dilation and point hits on hand-made pictures."""

from typetrace.operators import report, shapes as H


def ink(spark, *pictures):
    rows = [(n, y, x) for n, p in enumerate(pictures) for y, line in enumerate(p) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "image_id bigint, y bigint, x bigint")


def test_snake_is_one_component_and_diagonals_do_not_touch(spark):
    snake = []
    for y in range(41):
        snake.append("#" * 12 if y % 2 == 0 else ("." * 11 + "#" if y % 4 == 1 else "#" + "." * 11))
    lab = H.components(ink(spark, snake, ["#.", ".#"], ["##.##", ".###."]))
    counts = {r.image_id: r.n for r in lab.selectExpr("image_id", "component").distinct().groupBy("image_id").count()
              .withColumnRenamed("count", "n").collect()}
    assert counts == {0: 1, 1: 2, 2: 1}
    assert lab.count() == sum(line.count("#") for line in snake) + 2 + 7


def test_two_squares(spark):
    pic = [["."] * 40 for _ in range(40)]
    for a in (5, 25):
        for y in range(a, a + 10):
            for x in range(a, a + 10):
                pic[y][x] = "#"
    got = H.component_contours(H.components(ink(spark, pic))).orderBy("x").collect()
    assert [(r.n, r.x, r.y, r.w, r.h) for r in got] == [(100, 5, 5, 9, 9), (100, 25, 25, 9, 9)]


def test_dilation(spark):
    grown = H.dilate(ink(spark, ["#..", "...", "..."]), 3, 3, 3)
    assert sorted((r.y, r.x) for r in grown.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    even = H.dilate(ink(spark, ["...", ".#.", "..."]), 3, 3, 2)
    assert sorted((r.y, r.x) for r in even.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_small_point_sets(spark):
    pts = spark.createDataFrame(
        [(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 4.0), (2, 0, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, 6.0, 8.0)],
        "shape_id int, seq int, x double, y double")
    by = lambda df, c: {r.shape_id: r[c] for r in df.collect()}
    assert by(H.polygon_areas(pts), "area") == {1: 6.0, 2: 0.0, 3: 0.0}
    assert by(H.polyline_lengths(pts, closed=False), "length") == {1: 7.0, 2: 0.0, 3: 10.0}
    assert by(H.polyline_lengths(pts, closed=True), "length") == {1: 12.0, 2: 0.0, 3: 20.0}


def test_first_hit_over_box_sizes(spark):
    boxes = spark.createDataFrame(
        [(1, 7, 0, 0, 100000, 90000), (1, 3, 50, 50, 58, 58), (1, 9, 50, 50, 58, 58), (2, 1, 0, 0, 8, 8)],
        "image_id int, seq int, x1 int, y1 int, x2 int, y2 int")
    points = spark.createDataFrame(
        [(1, 1, 58, 50), (1, 2, 59, 50), (1, 3, 99999, 12), (2, 4, 9, 9), (2, 5, 8, 0)],
        "image_id int, point_id int, px int, py int")
    assert {r.point_id: r.hit for r in report.first_hit(points, boxes).collect()} == {1: 3, 2: 7, 3: 7, 5: 1}
