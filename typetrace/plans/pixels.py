"""Glyph fields, feature extraction, shapes and evaluation crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from typetrace.functions import bits
from typetrace.operators import fields as D, perturb, segment as G, shapes as H
from typetrace.plans import fixtures as fx
from typetrace.plans.registry import query
from typetrace.sources.images import from_base64

_PX = fx.with_views("pixels")


def _bitmaps(spark, sf):
    g = fx.glyphs(spark, sf)
    ink = F.transform("field", lambda v: (v > 0).cast("int"))
    return g.select(F.col("vec_id").alias("image_id"), "font_id", "char", bits.pack_words(ink, fx.WORDS).alias("bits"))


def _text(df, column="px"):
    return df.select("image_id", F.array_join(F.col(column).cast("array<string>"), "").alias("px"))


def _long(df, column):
    """Array column to rows, rounded for comparison."""
    return df.select("image_id", F.posexplode(column)).select(
        "image_id", F.col("pos").cast("bigint").alias("pos"), F.round("col", 6).alias("value"))


@query("G1", _PX + """
SELECT o.image_id, string_agg(px.ink, '' ORDER BY o.y, o.x) AS px
FROM (SELECT image_id, y, x FROM (SELECT DISTINCT image_id FROM px), range(0, 5) a(y), range(0, 5) b(x)) o
JOIN px ON px.image_id = o.image_id AND px.y = floor((o.y + 0.5) * 8 / 5) AND px.x = floor((o.x + 0.5) * 8 / 5)
GROUP BY o.image_id""")
def nearest_resize(spark, sf):
    return _text(D.resize_bitmaps(_bitmaps(spark, sf), fx.SIDE, 5))


@query("S4", _PX + """
SELECT image_id, base64(from_hex(px)) AS payload, px
FROM (SELECT image_id, string_agg(printf('%02X', level), '' ORDER BY y, x) AS px FROM px GROUP BY image_id)""")
def payload_pixels(spark, sf):
    """Images that arrive as base64 text of their raw levels."""
    digits = F.transform("px", lambda p: F.lpad(F.hex(p), 2, "0"))
    sent = fx.glyph_images(spark, sf).select("image_id", F.regexp_replace(F.base64(F.unhex(F.array_join(digits, ""))), r"\s", "").alias("payload"))
    return sent.select("image_id", "payload", F.hex(from_base64(F.col("payload"))).alias("px"))


_COEF = """
taps AS (
  SELECT n_in, n_out, o, i, greatest(1 - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * n_in / n_out) / greatest(n_in / n_out, 1), 0) AS w
  FROM sizes, range(0, n_out) a(o), range(0, n_in) b(i)
  WHERE i >= greatest(trunc((o + 0.5::DOUBLE) * n_in / n_out - greatest(n_in / n_out, 1) + 0.5), 0)
    AND i < least(trunc((o + 0.5::DOUBLE) * n_in / n_out + greatest(n_in / n_out, 1) + 0.5), n_in)),
coef AS (SELECT n_in, n_out, o, i, floor(w / sum(w) OVER (PARTITION BY n_in, n_out, o) * 4194304 + 0.5) AS k FROM taps WHERE w > 0)"""


@query("G2", _PX + ", sizes(n_in, n_out) AS (VALUES (8, 5), (8, 11))," + _COEF + """,
h AS (SELECT image_id, y, o AS x, least(greatest(floor((sum(level * k) + 2097152) / 4194304), 0), 255) AS v
      FROM px JOIN coef ON i = x AND n_out = 11 GROUP BY image_id, y, o),
v AS (SELECT image_id, o AS y, x, least(greatest(floor((sum(v * k) + 2097152) / 4194304), 0), 255)::INT AS v
      FROM h JOIN coef ON i = y AND n_out = 5 GROUP BY image_id, o, x)
SELECT image_id, string_agg(v, ' ' ORDER BY y, x) AS px FROM v GROUP BY image_id""")
def bilinear_resize(spark, sf):
    out = D.resize_levels(fx.glyph_images(spark, sf), 5, 11)
    return out.select("image_id", F.array_join(F.col("px").cast("array<string>"), " ").alias("px"))


@query("G3 G4", _PX + ", lv AS (SELECT image_id, level FROM px),\n" + fx.SQL["otsu"] + """,
side AS (SELECT image_id, threshold, count(*) FILTER (level <= threshold) * 2 <= count(*) AS dark
         FROM px JOIN thr USING (image_id) GROUP BY image_id, threshold),
m AS (SELECT image_id, y, x, CASE WHEN (level <= threshold) = dark THEN 255 ELSE 0 END AS v FROM px JOIN side USING (image_id)),
b AS (SELECT image_id, min(x) AS x0, max(x) + 1 - min(x) AS w, min(y) AS y0, max(y) + 1 - min(y) AS h FROM m WHERE v > 0 GROUP BY image_id),
f AS (SELECT *, greatest(round_even(h * least(128 / h, 128 / w), 0), 1)::BIGINT AS nh,
                greatest(round_even(w * least(128 / h, 128 / w), 0), 1)::BIGINT AS nw FROM b),
sizes AS (SELECT h AS n_in, nh AS n_out FROM f UNION SELECT w, nw FROM f),""" + _COEF + """,
hp AS (SELECT f.image_id, m.y - y0 AS y, o AS x, nh, nw, h, least(greatest(floor((sum(v * k) + 2097152) / 4194304), 0), 255) AS v
       FROM f JOIN m ON m.image_id = f.image_id AND m.x >= x0 AND m.x < x0 + w AND m.y >= y0 AND m.y < y0 + h
       JOIN coef ON n_in = w AND n_out = nw AND i = m.x - x0 GROUP BY ALL),
vp AS (SELECT image_id, o + (128 - nh) // 2 AS y, x + (128 - nw) // 2 AS x, floor((sum(v * k) + 2097152) / 4194304) > 32 AS ink
       FROM hp JOIN coef ON n_in = h AND n_out = nh AND i = y GROUP BY image_id, o, x, nh, nw)
SELECT image_id, count(*) AS n_ink, sum(y)::BIGINT AS sum_y, count(*) FILTER (x < 64) AS n_left FROM vp WHERE ink GROUP BY image_id""")
def normalised_crops(spark, sf):
    rows = D.normalise_crops(fx.glyph_images(spark, sf)).select("image_id", F.posexplode("bits"))
    n = F.bit_count("col")
    return rows.groupBy("image_id").agg(
        F.sum(n).alias("n_ink"), F.sum(n * F.expr("pos div 2")).alias("sum_y"),
        F.sum(F.when(F.col("pos") % 2 == 0, n).otherwise(0)).alias("n_left"))


_EDT = """
d AS (SELECT a.image_id, a.y, a.x, a.ink,
        sqrt(min(CASE WHEN b.ink = 0 THEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) END)) AS inside,
        sqrt(min(CASE WHEN b.ink = 1 THEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) END)) AS outside
      FROM px a JOIN px b USING (image_id) GROUP BY a.image_id, a.y, a.x, a.ink),
sdf AS (SELECT image_id, y, x, CASE WHEN s > 1e-6 THEN f / s ELSE 0 END AS v FROM (
  SELECT image_id, y, x, outside - inside AS f, stddev_pop(outside - inside) OVER (PARTITION BY image_id) AS s FROM d))"""


@query("G5", _PX + "," + _EDT + """
SELECT image_id, y * 8 + x AS pos, round(coalesce(inside, 'inf'::DOUBLE), 6) AS value FROM d""")
def distance_transform(spark, sf):
    return _long(D.distance_fields(_bitmaps(spark, sf), fx.SIDE), "dist")


@query("G6", _PX + "," + _EDT + " SELECT image_id, y * 8 + x AS pos, round(coalesce(v, 0), 6) AS value FROM sdf")
def signed_distance(spark, sf):
    return _long(D.signed_fields(_bitmaps(spark, sf), fx.SIDE), "field")


@query("G7", _PX + """
SELECT a.image_id, string_agg(coalesce(b.ink, 0), '' ORDER BY a.y, a.x) AS px
FROM px a LEFT JOIN px b ON b.image_id = a.image_id AND b.y = a.y - 1 AND b.x = a.x + 2 GROUP BY a.image_id""")
def shifted_bitmaps(spark, sf):
    return _text(D.shift_bitmaps(_bitmaps(spark, sf), fx.SIDE, 1, -2))


@query("G8", fx.with_views("glyphs", "features") + """,
q AS (SELECT c.mark_id, i // 8 AS y, i % 8 AS x, c.cf[i + 1] AS a, t.field AS tf
      FROM crop_f c JOIN glyphs t ON t.font_id = c.true_font AND t.char = c.char, range(0, 64) r(i)),
s AS (SELECT mark_id, dy, dx, sum(a * b) AS num, sum(a * a) AS aa, sum(b * b) - sum(b) * sum(b) / 64 AS bb
      FROM (SELECT mark_id, dy, dx, a, CASE WHEN y - dy BETWEEN 0 AND 7 AND x - dx BETWEEN 0 AND 7
              THEN tf[(y - dy) * 8 + x - dx + 1] ELSE 0 END AS b
            FROM q, range(-2, 3) u(dy), range(-2, 3) v(dx)) GROUP BY ALL)
SELECT mark_id, round(greatest(max(CASE WHEN sqrt(aa * bb) < 1e-9 THEN 0 ELSE num / sqrt(aa * bb) END), 0), 6) AS ncc
FROM s GROUP BY mark_id""")
def aligned_correlation(spark, sf):
    crops = fx.raw_crops(spark, sf).select("mark_id", F.col("true_font").alias("font_id"), "char", F.col("field").alias("a"))
    own = fx.glyphs(spark, sf).select("font_id", "char", F.col("field").alias("b"))
    scored = D.aligned_scores(crops.join(own, ["font_id", "char"]), "a", "b", fx.SIDE, 2)
    return scored.select("mark_id", F.round("ncc", 6).alias("ncc"))


@query("G9", _PX + """,
g AS (SELECT p.image_id, p.y, p.x,
        CASE p.x WHEN 0 THEN r.ink - p.ink WHEN 7 THEN p.ink - l.ink ELSE (r.ink - l.ink) / 2 END::DOUBLE AS gx,
        CASE p.y WHEN 0 THEN d.ink - p.ink WHEN 7 THEN p.ink - u.ink ELSE (d.ink - u.ink) / 2 END::DOUBLE AS gy
      FROM px p LEFT JOIN px l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x - 1
      LEFT JOIN px r ON r.image_id = p.image_id AND r.y = p.y AND r.x = p.x + 1
      LEFT JOIN px u ON u.image_id = p.image_id AND u.x = p.x AND u.y = p.y - 1
      LEFT JOIN px d ON d.image_id = p.image_id AND d.x = p.x AND d.y = p.y + 1),
b AS (SELECT image_id, (y // 4 * 2 + x // 4) * 8
        + least(trunc(((atan2(gy, gx)::FLOAT + pi()::FLOAT)::FLOAT % pi()::FLOAT)::FLOAT / (pi() / 8)::FLOAT), 7)::BIGINT AS pos,
        sqrt(gx * gx + gy * gy) AS m FROM g),
s AS (SELECT image_id, pos, sum(m) AS m FROM b GROUP BY ALL)
SELECT i.image_id, i.pos, round(coalesce(m, 0) / n, 6) AS value
FROM (SELECT image_id, pos, sqrt(t) AS n FROM (SELECT image_id, sum(m * m) AS t FROM s GROUP BY 1), range(0, 32) r(pos)) i
LEFT JOIN s USING (image_id, pos)""")
def orientation_histograms(spark, sf):
    return _long(D.orientation_histograms(_bitmaps(spark, sf), fx.SIDE, cells=2), "vec")


@query("G11 S5", _PX + "," + _EDT + """
SELECT vec_id // 5 AS font_id, chr((97 + vec_id % 5)::INT) AS char, pop, round(f, 4) AS field_abs FROM (
  SELECT image_id AS vec_id, sum(ink)::BIGINT AS pop FROM px GROUP BY 1)
JOIN (SELECT image_id AS vec_id, sum(abs(coalesce(v, 0))) AS f FROM sdf GROUP BY 1) USING (vec_id)""")
def template_index(spark, sf):
    index = D.build_index(_bitmaps(spark, sf), fx.SIDE, fx.SIDE, cells=2)
    total = F.aggregate("field", F.lit(0.0), lambda s, v: s + F.abs(v))
    return index.select("font_id", "char", F.col("pop").cast("bigint").alias("pop"), F.round(total, 4).alias("field_abs"))


def _ink(spark, sf):
    return fx.pixel_table(spark, sf).filter(F.col("ink") == 1).select(
        "image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


@query("G12", _PX + """
SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM px, range(-1, 2) a(dy), range(-1, 2) b(dx)
WHERE ink = 1 AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7""")
def dilated_ink(spark, sf):
    return H.dilate(_ink(spark, sf), fx.SIDE, fx.SIDE, 3)


_COMPONENTS = """WITH RECURSIVE px AS (
  SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x FROM embeddings, range(0, 64) t(i) WHERE embedding[i + 1] > 0),
reach AS (
  SELECT image_id, y, x, y * 8 + x AS root FROM px
  UNION
  SELECT p.image_id, p.y, p.x, r.root FROM reach r JOIN px p
    ON p.image_id = r.image_id AND abs(p.y - r.y) + abs(p.x - r.x) = 1),
lab AS (SELECT image_id, y, x, min(root) AS root FROM reach GROUP BY image_id, y, x)
"""


@query("G13", _COMPONENTS + "SELECT image_id, y, x, root // 8 AS root_y, root % 8 AS root_x FROM lab")
def connected_components(spark, sf):
    lab = H.components(_ink(spark, sf))
    return lab.select("image_id", "y", "x", F.shiftright("component", 32).alias("root_y"),
                      F.col("component").bitwiseAND(F.lit(0xFFFFFFFF)).alias("root_x"))


@query("G14 A19", _COMPONENTS + """
SELECT image_id, count(*) AS n, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h
FROM lab GROUP BY image_id, root""")
def component_contours(spark, sf):
    return H.component_contours(H.components(_ink(spark, sf))).drop("component")


@query("G15", _PX + """
SELECT 1 AS turns, image_id, x AS y, 7 - y AS x FROM px WHERE ink = 1
UNION ALL SELECT 2, image_id, 7 - y, 7 - x FROM px WHERE ink = 1
UNION ALL SELECT 3, image_id, 7 - x, y FROM px WHERE ink = 1""")
def rotated_ink(spark, sf):
    px = _ink(spark, sf)
    turn = lambda n: H.rotate(px, fx.SIDE, fx.SIDE, n).withColumn("turns", F.lit(n))
    return turn(1).unionByName(turn(2)).unionByName(turn(3))


def _points(spark, sf):
    pairs = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("shape_id"), F.posexplode(F.col("embedding").cast("array<double>")))
    return pairs.groupBy("shape_id", F.expr("pos div 2").alias("seq")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("col"))).alias("x"),
        F.max(F.when(F.col("pos") % 2 == 1, F.col("col"))).alias("y"))


_POINTS = """WITH pts AS (SELECT vec_id AS shape_id, i AS seq, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y,
  embedding[2 * ((i + 1) % 32) + 1]::DOUBLE AS nx, embedding[2 * ((i + 1) % 32) + 2]::DOUBLE AS ny
  FROM embeddings, range(0, 32) r(i))
"""


@query("A19", _POINTS + """
SELECT shape_id, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM pts GROUP BY shape_id""")
def bounding_rectangles(spark, sf):
    return H.bounding_rectangles(_points(spark, sf))


@query("A20", _POINTS + "SELECT shape_id, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area FROM pts GROUP BY shape_id")
def polygon_areas(spark, sf):
    return H.polygon_areas(_points(spark, sf)).withColumn("area", F.round("area", 6))


@query("A21", _POINTS + """
SELECT shape_id, round(sum(CASE WHEN seq < 31 THEN sqrt((nx - x) ** 2 + (ny - y) ** 2) ELSE 0 END), 6) AS open,
       round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) AS closed FROM pts GROUP BY shape_id""")
def polyline_lengths(spark, sf):
    p = _points(spark, sf)
    opened = H.polyline_lengths(p, closed=False).select("shape_id", F.round("length", 6).alias("open"))
    return opened.join(H.polyline_lengths(p, closed=True).select("shape_id", F.round("length", 6).alias("closed")), "shape_id")


def _uniform(slot):
    """Draw of an image and a slot under seed 0."""
    return f"((('0x' || substr(md5('0/' || image_id || '/' || {slot}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)"


def _normal(slot):
    radius, turn = (_uniform(f"{slot} || '/{end}'") for end in "rt")
    return f"(sqrt(-2.0::DOUBLE * ln({radius})) * cos({turn} * 6.283185307179586::DOUBLE))"


def _clamp(v):
    return f"floor(least(greatest({v}, 0.0::DOUBLE), 255.0::DOUBLE))::INT"


def _glyph_table(spark, sf):
    """Bitmaps of all glyphs as arrays, ready for perturbation."""
    return fx.glyphs(spark, sf).select(
        F.col("vec_id").alias("glyph_id"), F.lit(fx.SIDE).alias("height"), F.lit(fx.SIDE).alias("width"),
        F.transform("field", lambda v: (v > 0).cast("int")).alias("ink"))


def _joined(df):
    return df.select("glyph_id", "mode", F.array_join(F.col("px").cast("array<string>"), " ").alias("px"))


@query("T1 T2 S10 J9", _PX + f""",
v AS (SELECT image_id, y * 8 + x AS i, ink, {_normal("'offset'")} * 30 AS o,
             {_normal('(y * 8 + x)')} * 18 AS n FROM px)
SELECT image_id AS glyph_id, 'clean' AS mode, string_agg(ink * 255, ' ' ORDER BY i) AS px FROM v GROUP BY image_id
UNION ALL SELECT image_id, 'noise', string_agg({_clamp('ink * 255 + o + n')}, ' ' ORDER BY i) FROM v GROUP BY image_id""")
def noisy_crops(spark, sf):
    return _joined(perturb.evaluation_set(_glyph_table(spark, sf), ("clean", "noise")))


@query("T3", _PX + f""",
c AS (SELECT image_id, y * 8 + x AS i, x, ink, {_uniform("'side'")} < 0.5 AS dark,
             {_uniform("'paper'")} AS u2, {_uniform("'pen'")} AS u3,
             {_normal('(y * 8 + x)')} * 6 AS n FROM px),
p AS (SELECT *, CASE WHEN dark THEN 120 + floor(u2 * 101) ELSE floor(u2 * 71) END AS paper,
             CASE WHEN dark THEN floor(u3 * 41) ELSE 190 + floor(u3 * 51) END AS pen FROM c)
SELECT image_id AS glyph_id, 'background' AS mode,
       string_agg(CASE WHEN ink > 0 THEN {_clamp('pen + n')} ELSE {_clamp('paper + (-25 + 50 * x / 7)')} END, ' ' ORDER BY i) AS px
FROM p GROUP BY image_id""")
def background_crops(spark, sf):
    return _joined(perturb.evaluation_set(_glyph_table(spark, sf), ("background",)))


@query("T4 T5", _PX + f""",
ink AS (SELECT image_id, y, x, ink * 255 AS level FROM px),
amount AS (SELECT DISTINCT image_id, greatest(8, floor(8 * (0.5 + {_uniform("'scale'")} * 1.5)))::BIGINT AS n_out,
             0.5 + {_uniform("'blur'")} AS sigma FROM px),
sizes AS (SELECT DISTINCT 8::BIGINT AS n_in, n_out FROM amount),""" + _COEF + """,
sh AS (SELECT image_id, y, n_out, o AS x, least(greatest(floor((sum(level * k) + 2097152) / 4194304), 0), 255) AS v
       FROM ink JOIN amount USING (image_id) JOIN coef USING (n_out) WHERE i = x GROUP BY ALL),
sv AS (SELECT image_id, n_out, o AS y, x, least(greatest(floor((sum(v * k) + 2097152) / 4194304), 0), 255)::INT AS v
       FROM sh JOIN coef USING (n_out) WHERE i = y GROUP BY image_id, n_out, o, x),
kern AS (SELECT image_id, d, exp(-0.5 * (d / sigma) ** 2) / sum(exp(-0.5 * (d / sigma) ** 2)) OVER (PARTITION BY image_id) AS k
         FROM amount, range(-5, 6) r(d) WHERE abs(d) <= greatest(1, ceil(3 * sigma))),
wt AS (SELECT image_id, o, least(greatest(o + d, 0), 7) AS i, sum(k) AS w FROM kern, range(0, 8) r(o) GROUP BY ALL),
bh AS (SELECT image_id, y, o AS x, sum(level * w) AS v FROM ink JOIN wt USING (image_id) WHERE i = x GROUP BY image_id, y, o),
bv AS (SELECT image_id, o AS y, x, least(greatest(floor(sum(v * w) + 1e-9), 0), 255)::INT AS v
       FROM bh JOIN wt USING (image_id) WHERE i = y GROUP BY image_id, o, x)
SELECT image_id AS glyph_id, 'scale' AS mode, n_out AS side, string_agg(v, ' ' ORDER BY y, x) AS px FROM sv GROUP BY image_id, n_out
UNION ALL SELECT image_id, 'blur', 8, string_agg(v, ' ' ORDER BY y, x) FROM bv GROUP BY image_id""")
def resampled_crops(spark, sf):
    made = perturb.evaluation_set(_glyph_table(spark, sf), ("scale", "blur"))
    return made.select("glyph_id", "mode", F.col("height").cast("bigint").alias("side"),
                       F.array_join(F.col("px").cast("array<string>"), " ").alias("px"))
