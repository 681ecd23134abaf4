"""The automatic flow against a plain loop over the same line images."""

from collections import defaultdict

import numpy as np

from typetrace.functions import rasters as R
from typetrace.operators import auto as A
from typetrace.operators.segment import fold_fragments
from typetrace.plans import fixtures as fx
from typetrace.plans.auto import SHAPE

SF = "/root/testdata/sf0.001"


def naive_search(bitmap, index):
    small = R.resize_nearest(bitmap[None], 8)
    field, vec = R.signed_field(small), R.orientation_histogram(bitmap[None], 2, 8)[0]
    inter = (index["bits"] * small.reshape(1, -1)).sum(axis=1)
    union = np.maximum(index["bits"], small.reshape(1, -1)).sum(axis=1)
    first = sorted(range(len(inter)), key=lambda i: (-inter[i] / union[i], index["font"][i], index["char"][i]))[:10]
    scored = [(0.65 * R.aligned_pairs(field, index["field"][i:i + 1], 2)[0] + 0.35 * min(max(vec @ index["vec"][i], 0), 1), i)
              for i in first]
    best = min(scored, key=lambda s: (-s[0], index["font"][s[1]], index["char"][s[1]]))
    return index["font"][best[1]], index["char"][best[1]], best[0]


def trimmed(mask):
    rows = np.flatnonzero(mask.any(axis=1))
    return R.fit_and_centre(mask[rows[0]:rows[-1] + 1].astype(np.uint8), 8)


def naive_free(ink, width, index):
    seen = []
    runs = [(int(a), int(b), int(c), int(d), b - a >= 5 or b == width) for a, b, c, d in zip(*R.runs_of(ink))]
    for x0, x1, y0, y1 in fold_fragments(runs):
        n = max(1, int(np.ceil((x1 - x0) / max((y1 - y0 + 1) * 1.35, 1))))
        for i in range(n):
            a, b = x0 + (x1 - x0) * i // n, x0 + (x1 - x0) * (i + 1) // n
            if ink[:, a:b].any():
                font, char, score = naive_search(trimmed(ink[:, a:b]), index)
                if score >= 0.6:
                    seen.append((font, score))
    return seen


def naive_route(line, ink, gray, index):
    segs = [(int(a), int(b)) for a, b, *_ in zip(*R.runs_of(ink)) if b - a >= 5 or b == line.width]
    if segs:
        median = sorted(b - a for a, b in segs)[len(segs) // 2]
        segs = [s for s in segs if s[1] - s[0] > 0.35 * median]
    if line.score < 0.6:
        return "free"
    chars = [c for c in line.text[:20] if c.isalnum()]
    if not chars:
        return "skip"
    if len(segs) != len(chars):
        return "free"
    for (a, b), c in zip(segs, chars):
        rows = np.flatnonzero(ink[:, a:b].any(axis=1))
        own = R.ink_of(gray[rows[0]:rows[-1] + 1, a:b])
        if own is None:
            return "free"
        _, char, score = naive_search(trimmed(own), index)
        if char != c or score < 0.6:
            return "free"
    return "guided"


def test_flow_equals_plain_loop(spark):
    lines, templates = fx.line_images(spark, SF).cache(), fx.bitmap_index(spark, SF).cache()
    t = templates.orderBy("font_id", "char").toPandas()
    index = {"font": t["font_id"].tolist(), "char": t["char"].tolist(),
             "bits": R.unpack(list(t["words"]), 1).astype(int),
             "field": np.stack(list(t["field"])).reshape(-1, 8, 8), "vec": np.stack(list(t["vec"]))}
    out = A.auto_match(lines, templates, fx.groups(spark, SF), SHAPE)
    routes = {r.line_id: r.route for r in out["lines"].collect()}
    images = {r.image_id: r for r in out["images"].collect()}

    per_image = defaultdict(list)
    for r in lines.collect():
        per_image[r.image_id].append(r)
    rep = {1: 0, 3: 2}
    want_routes, checked = {}, 0
    for image, rows in per_image.items():
        area = lambda r: (r.box[2].x - r.box[0].x) * (r.box[2].y - r.box[0].y)
        rows = sorted(rows, key=lambda r: (-area(r), r.line_no))[:3]
        votes, kinds = [], []
        for r in rows:
            gray = R.as_image(r.px, r.height, r.width)
            ink = R.ink_of(gray)
            kind = naive_route(r, ink, gray, index)
            want_routes[r.line_id] = kind
            kinds.append(kind)
            if kind == "free":
                votes += naive_free(ink, r.width, index)
        if "guided" in kinds or not votes:
            continue
        scores = defaultdict(list)
        for font, s in votes:
            scores[rep.get(font, font)].append(s)
        best = min(scores.items(), key=lambda kv: (-len(kv[1]), -np.mean(kv[1]), kv[0]))
        got = images[image]
        assert (got.best_font, got.votes, got.outcome) == (best[0], len(best[1]), "mixed")
        assert abs(got.confidence - np.mean(best[1])) < 1e-9
        checked += 1
    assert routes == want_routes and checked > 20
    assert "guided" in routes.values() and "skip" in routes.values()


def test_guided_image_uses_rank_weights_and_blank_image_is_an_error(spark):
    lines = fx.line_images(spark, SF).filter("line_no = 0")
    lines = lines.selectExpr("*").drop("score", "text").selectExpr("*", "'abcde' AS text", "0.99D AS score")
    out = A.auto_match(lines, fx.bitmap_index(spark, SF), fx.groups(spark, SF), SHAPE)
    guided = out["images"].filter("outcome = 'guided'").collect()
    assert len(guided) > 20
    assert all(r.best_font == {1: 0, 3: 2}.get(r.image_id, r.image_id) for r in guided)
    assert all(r.confidence == round(r.confidence, 4) and r.verdict in ("free", "suspect") for r in guided)
    images = spark.createDataFrame([(1, 2, 2, [9, 9, 9, 9]), (2, 2, 2, [0, 200, 200, 200])],
                                   "image_id bigint, height int, width int, px array<int>")
    assert [r.image_id for r in A.blank_images(images).collect()] == [1]


def test_punctuation_only_is_unknown(spark):
    lines = fx.line_images(spark, SF).filter("image_id = 0").drop("score", "text").selectExpr(
        "*", "'-,.' AS text", "0.99D AS score")
    got = A.auto_match(lines, fx.bitmap_index(spark, SF), fx.groups(spark, SF), SHAPE)["images"].collect()
    assert [(r.outcome, r.verdict, r.confidence, r.votes) for r in got] == [("none", "unknown", 0.0, 0)]


def small_tables(folder, ids):
    """Own tables of glyphs, as a folder of one file, and of fonts; the fields of rows stay the same whichever are left out."""
    import duckdb

    (folder / "embeddings.parquet").mkdir(parents=True)
    listed = ", ".join(f"({i})" for i in ids)
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT v::BIGINT AS vec_id, list_transform(range(0, 64), lambda i: (((v * 7919 + i * 104729 + v * i * 31) % 1009) / 1009.0 - 0.5)::FLOAT) AS embedding
        FROM (VALUES {listed}) t(v)) TO '{folder}/embeddings.parquet/part-0.parquet'""")
    con.execute(f"COPY (SELECT range::BIGINT AS p_partkey, (range * 7 % 50)::INT AS p_size, 'n' || range AS p_name, 'b' AS p_brand, 't' AS p_type FROM range(0, 20)) TO '{folder}/part.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    return con, str(folder)


def test_lines_of_fonts_without_some_glyphs(spark, tmp_path):
    from compare import compare
    from typetrace.plans import REGISTRY

    con, sf = small_tables(tmp_path / "sf", [i for i in range(51) if i not in (7, 20, 34)])
    for name in ("undetected_image_verdicts", "auto_candidates"):
        ok, message = compare(spark, con, REGISTRY[name], sf)
        assert ok, (name, message)


def test_lines_with_repeated_or_empty_glyphs(spark, tmp_path):
    field = [0.5 if i % 8 == 2 else -0.5 for i in range(64)]
    rows = [(v, field) for v in (0, 1, 1, 2, 3, 4)] + [(5, None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in fx.line_images(spark, str(tmp_path)).collect():
        assert len(r.px) == r.height * r.width
        got.setdefault(r.image_id, set()).add(r.width)
    assert max(got[0]) >= 58 and got[1] == {48}
