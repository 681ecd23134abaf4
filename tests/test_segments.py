"""Column runs, filters and folds against golden vectors and naive loops."""

import random
import re

from pyspark.sql import functions as F

from typetrace.operators import segment as G


def cols(spark, lines):
    """{line: text} with '#' for an inked column of rows 0..height-1."""
    rows = [(n, x, 0, h - 1) for n, (t, h) in lines.items() for x, c in enumerate(t) if c == "#"]
    widths = [(n, len(t)) for n, (t, _) in lines.items()]
    return (spark.createDataFrame(rows, "line_id bigint, x int, y0 int, y1 int"),
            spark.createDataFrame(widths, "line_id bigint, width int"))


def spans(df):
    return sorted((r.line_id, r.x0, r.x1) for r in df.collect())


def test_short_closed_runs_are_dropped_but_not_at_the_edge(spark):
    c, w = cols(spark, {1: ("####.#####.#", 9)})
    assert spans(G.long_enough(G.column_runs(c), w)) == [(1, 5, 10), (1, 11, 12)]


def test_runs_are_stitched_over_chunks(spark):
    c, w = cols(spark, {1: ("#" * 37 + "." + "#" * 11, 9), 2: ("." * 8 + "#" * 8, 9)})
    assert spans(G.column_runs(c, chunk=8)) == [(1, 0, 37), (1, 38, 49), (2, 8, 16)]


def test_upper_median_width_rule(spark):
    segs = spark.createDataFrame(
        [(1, 0, 2, 0, 9), (1, 10, 20, 0, 9), (1, 30, 40, 0, 9), (1, 50, 60, 0, 9)],
        "line_id bigint, x0 int, x1 int, y0 int, y1 int")
    assert spans(G.drop_narrow(segs)) == [(1, 10, 20), (1, 30, 40), (1, 50, 60)]


def test_fragment_joins_the_smaller_gap_and_right_on_a_tie():
    wide = lambda a: (a, a + 10, 0, 9, True)
    bit = lambda a: (a, a + 2, 0, 9, True)
    assert G.fold_fragments([wide(0), bit(12), wide(20)]) == [(0, 14, 0, 9), (20, 30, 0, 9)]
    assert G.fold_fragments([wide(0), bit(14), wide(18)]) == [(0, 10, 0, 9), (14, 28, 0, 9)]
    assert G.fold_fragments([wide(0), bit(13), wide(18)]) == [(0, 10, 0, 9), (13, 28, 0, 9)]
    # merged to the right it is still narrow, so it is looked at again
    assert G.fold_fragments([bit(0), bit(2), wide(20)]) == [(0, 30, 0, 9)]
    assert G.fold_fragments([bit(0)]) == [(0, 2, 0, 9)]


def naive_fragments(runs, share):
    """List surgery with extents looked up afresh for every test."""
    def height(a, b):
        inside = [r for r in runs if r[0] < b and r[1] > a]
        return max(r[3] for r in inside) - min(r[2] for r in inside) + 1

    segs = [(r[0], r[1]) for r in runs if r[4]]
    i = 0
    while i < len(segs) and len(segs) > 1:
        a, b = segs[i]
        if (b - a) / height(a, b) >= share:
            i += 1
            continue
        gap_l = a - segs[i - 1][1] if i else float("inf")
        gap_r = segs[i + 1][0] - b if i + 1 < len(segs) else float("inf")
        if i + 1 < len(segs) and gap_r <= gap_l:
            segs[i:i + 2] = [(a, segs[i + 1][1])]
        else:
            segs[i - 1:i + 1] = [(segs[i - 1][0], b)]
    return segs


def test_fragment_fold_equals_list_surgery():
    rnd = random.Random(5)
    for _ in range(400):
        runs, x = [], 0
        for _ in range(rnd.randint(1, 14)):
            x += rnd.randint(1, 6)
            w = rnd.randint(1, 14)
            y0 = rnd.randint(0, 6)
            runs.append((x, x + w, y0, y0 + rnd.randint(0, 20), w >= 5))
            x += w
        got = [(s[0], s[1]) for s in G.fold_fragments(runs)]
        assert got == naive_fragments(runs, G.FRAGMENT), runs


def naive_closest(segs, n):
    segs = list(segs)
    while len(segs) > n and len(segs) >= 2:
        i = min(range(len(segs) - 1), key=lambda j: (segs[j + 1][1] - segs[j][0], j))
        segs[i:i + 2] = [(segs[i][0], segs[i + 1][1])]
    return segs


def test_closest_pairs_merge_first():
    assert G.fold_closest([(0, 5), (6, 9), (12, 16), (30, 33), (34, 36)], 3) == [(0, 9), (12, 16), (30, 36)]
    rnd = random.Random(6)
    for _ in range(400):
        x, segs = 0, []
        for _ in range(rnd.randint(1, 15)):
            x += rnd.randint(1, 9)
            segs.append((x, x + rnd.randint(1, 9)))
            x = segs[-1][1]
        n = rnd.randint(1, 6)
        assert G.fold_closest(segs, n) == naive_closest(segs, n), (segs, n)


def test_folds_run_per_line(spark):
    runs = spark.createDataFrame(
        [(1, 0, 10, 0, 9), (1, 12, 17, 0, 19), (1, 30, 45, 0, 9), (2, 0, 5, 0, 4)],
        "line_id bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint")
    widths = spark.createDataFrame([(1, 60), (2, 60)], "line_id bigint, width int")
    assert spans(G.merge_fragments(runs, widths)) == [(1, 0, 17), (1, 30, 45), (2, 0, 5)]
    wanted = spark.createDataFrame([(1, 1), (2, 3)], "line_id bigint, n_chars int")
    assert spans(G.merge_to_count(runs, wanted)) == [(1, 0, 45), (2, 0, 5)]


def test_wide_and_equal_splits(spark):
    segs = spark.createDataFrame([(1, 10, 40, 0, 9)], "line_id bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint")
    assert spans(G.split_wide(segs)) == [(1, 10, 20), (1, 20, 30), (1, 30, 40)]
    parts = G.equal_split(segs.withColumn("n", F.lit(4)), "n").orderBy("part").collect()
    assert [(r.a, r.b) for r in parts] == [(10, 17), (17, 25), (25, 32), (32, 40)]


def plain_characters(runs, width, chars):
    """The rules one after the other, each over whole lists."""
    segs = [(a, b) for a, b, _, _ in runs if b - a >= 5 or b == width]
    widths = sorted(b - a for a, b in segs)
    segs = [s for s in segs if s[1] - s[0] > 0.35 * widths[len(widths) // 2]]
    if not segs or not chars:
        return []
    while len(segs) > len(chars):
        i = min(range(len(segs) - 1), key=lambda k: segs[k + 1][1] - segs[k][0])
        segs[i:i + 2] = [(segs[i][0], segs[i + 1][1])]
    inside = lambda a, b: [r for r in runs if r[0] >= a and r[1] <= b]
    if len(segs) < len(chars):
        a, b, n = runs[0][0], runs[-1][1], len(chars)
        if b - a < n:
            return []
        rows = inside(a, b)
        segs = [(a + (b - a) * i // n, a + (b - a) * (i + 1) // n) for i in range(n)]
    else:
        rows = None
    return [(i, c, *s, min(r[2] for r in rows or inside(*s)), max(r[3] for r in rows or inside(*s))) for i, (c, s) in enumerate(zip(chars, segs))]


def test_segments_of_characters_against_plain_rules():
    rnd = random.Random(11)
    seen = set()
    for _ in range(3000):
        x, runs = rnd.randrange(3), []
        for _ in range(rnd.randrange(1, 12)):
            w, y0 = rnd.choice((1, 2, 4, 5, 6, 9, 20)), rnd.randrange(5)
            runs.append((x, x + w, y0, y0 + rnd.randrange(9)))
            x += w + rnd.randrange(1, 6)
        width = runs[-1][1] + rnd.randrange(2)
        chars = list("abcdefghijklmnopqrstuvwxyz"[:rnd.randrange(27)])
        want = plain_characters(runs, width, chars)
        assert G.fold_to_characters(runs, width, chars) == want
        seen.add((bool(want), len(runs) > len(chars)))
    assert len(seen) == 4


def test_lines_are_given_up_whole(spark):
    c, _ = cols(spark, {1: ("#####.#####", 9), 2: ("##", 9), 3: ("#####", 9)})
    lines = spark.createDataFrame([(1, 12, ["a", "b"]), (2, 2, list("abc")), (3, 9, []), (4, 9, ["a"])], "line_id bigint, width int, chars array<string>")
    got = sorted(tuple(r) for r in G.character_segments(G.column_runs(c), lines).collect())
    assert got == [(1, 0, "a", 0, 5, 0, 8), (1, 1, "b", 6, 11, 0, 8)]


def test_runs_of_packed_columns_in_any_order(spark):
    rng = random.Random(5)
    texts = {n: ("".join(rng.choice("##.") for _ in range(rng.randrange(1, 90))), n + 1) for n in range(40)}
    c, _ = cols(spark, texts)
    want = spans(G.column_runs(c))
    assert want == sorted((n, m.start(), m.end()) for n, (t, _) in texts.items() for m in re.finditer("#+", t))
    assert spans(G.column_runs(c.orderBy(F.xxhash64("line_id", "x")).repartition(7))) == want
    keyed = c.withColumn("line_id", F.struct("line_id", F.lit(None).cast("int").alias("y")))
    assert spans(G.column_runs(keyed).withColumn("line_id", F.col("line_id.line_id"))) == want


def test_columns_meet_packed(spark):
    """One row a run goes through the shuffle, not one a column."""
    c, _ = cols(spark, {1: ("#" * 400 + "." + "#" * 300, 9)})
    assert G._packed_columns(c.coalesce(1), "line_id").count() == 2


def test_repeated_columns_keep_their_rows(spark):
    c, _ = cols(spark, {1: ("####", 3), 2: (".##", 2)})
    got = spans(G.column_runs(c.union(c.filter("line_id = 1 AND x = 3"))))
    assert got == [(1, 0, 4), (1, 3, 4), (2, 1, 3)]


def test_very_long_lines_are_cut_without_overflow(spark):
    bounds = spark.createDataFrame([("a", 5, 100_005, 0, 0)], "line_id string, x0 int, x1 int, y0 int, y1 int")
    parts = G.equal_split(bounds.withColumn("n", F.lit(90_000)), "n").orderBy("part").collect()
    assert len(parts) == 90_000 and (parts[-1].a, parts[-1].b) == (5 + 100_000 * 89_999 // 90_000, 100_005)
    assert all(p.b == q.a for p, q in zip(parts, parts[1:]))
    wide = G.split_wide(bounds).orderBy("part").collect()
    assert len(wide) == 74_075 and (wide[0].x0, wide[-1].x1) == (5, 100_005)


def test_a_line_meets_packed_as_one_value(spark):
    """Lines of many short runs take one row, and neither runs nor characters are shuffled a row each."""
    c, w = cols(spark, {1: ("##." * 100, 9), 2: ("#....." * 60, 4)})
    assert G._packed_columns(c.coalesce(1), "line_id").count() == 2
    lines = w.withColumn("line", F.lit("abc"))
    segs = G.number_segments(G.drop_narrow(G.long_enough(G.column_runs(c, packed=True), lines, shortest=1)))
    paired = G.with_chars(segs, lambda t: F.split(t["line"], ""))
    assert paired._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted(tuple(r) for r in paired.collect()) == [(n, i, 3 * n * i, 3 * n * i + 3 - n, c) for n in (1, 2) for i, c in enumerate("abc")]


def test_packed_lines_give_the_rows_of_runs(spark):
    """Also where columns, and what is known of a line, repeat, and where a line or its width is not known."""
    rng = random.Random(9)
    texts = {n: ("".join(rng.choice("####.") for _ in range(rng.randrange(1, 70))), rng.randrange(1, 25)) for n in range(30)}
    c, w = cols(spark, texts)
    c = c.union(c.filter("line_id % 7 = 3")).union(c.filter("line_id = 4").withColumn("line_id", F.lit(None).cast("bigint")))
    w = w.union(w.filter("line_id % 5 = 1")).union(spark.createDataFrame([(2, None), (None, 9)], w.schema))
    chars = F.transform(F.sequence(F.lit(1), F.col("width") % 6 + 1), lambda i: F.chr(i + 96))
    lines = w.withColumn("chars", chars)
    flat, packed = G.column_runs(c.repartition(5), chunk=7), G.column_runs(c.repartition(5), chunk=7, packed=True)
    some = lambda df: sorted(map(str, G.unpacked(df).select("line_id", "x0", "x1", "y0", "y1").collect()))
    assert some(packed) == some(flat)
    long = [G.long_enough(r, w) for r in (flat, packed)]
    kept = [G.drop_narrow(r) for r in long]
    assert some(long[0]) == some(long[1]) and some(kept[0]) == some(kept[1]) and len(some(kept[0])) > 50
    assert some(G.split_wide(long[0])) == some(G.split_wide(long[1]))
    assert some(G.merge_fragments(flat, w)) == some(G.merge_fragments(packed, w))
    wanted = long[0].groupBy("line_id").agg(F.ceil(F.count("*") / 2).alias("n_chars"))
    assert spans(G.merge_to_count(long[0], wanted)) == spans(G.merge_to_count(long[1].withColumn("n_chars", F.ceil(F.size("runs") / 2))))
    once = lines.distinct().filter("line_id % 7 <> 3")   # runs that overlap are no line of characters
    marks = [sorted(map(str, G.character_segments(r, once).collect())) for r in (flat, packed)]
    assert marks[0] == marks[1] and len(marks[0]) > 20
