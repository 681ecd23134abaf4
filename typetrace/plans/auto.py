"""The automatic flow over line images built from the glyph table."""

from __future__ import annotations

from pyspark.sql import functions as F

from typetrace.functions import text as T
from typetrace.operators import auto as A, fields as D, search
from typetrace.plans import fixtures as fx
from typetrace.plans.lines import _FOLD
from typetrace.plans.pixels import _COEF
from typetrace.plans.registry import query
from typetrace.session import cut_lineage
from typetrace.sources import lines as L

def _index(spark, sf):
    """The stored index; searches read it several times."""
    return cut_lineage(fx.bitmap_index(spark, sf))


SHAPE = A.Shape(side=fx.SIDE, index_side=fx.SIDE, cells=2, reach=2)


@query("P11 P12", fx.with_views("ocr") + """
, r AS (SELECT image_id, line_no, score, len(regexp_extract_all(substr(text, 1, 20), '[\\p{L}\\p{N}]')) AS n_chars,
               length(text) - 1 AS n_segs, k % 5 <> 0 AS agree FROM valid),
routed AS (SELECT image_id, line_no, CASE WHEN score < 0.6 THEN 'free' WHEN n_chars = 0 THEN 'skip'
             WHEN n_segs <> n_chars THEN 'free' WHEN NOT agree THEN 'free' ELSE 'guided' END AS route FROM r)
SELECT image_id, count(*) FILTER (route = 'free') AS n_free, count(*) FILTER (route = 'guided') AS n_guided,
       CASE WHEN count(*) FILTER (route = 'free') > 0 THEN 'mixed' WHEN count(*) FILTER (route = 'guided') > 0 THEN 'guided' ELSE 'none' END AS outcome
FROM routed GROUP BY image_id""")
def line_routes(spark, sf):
    agree = (F.col("image_id") * 4 + F.col("line_no")) % 5 != 0
    route = A.line_route(F.col("score"), F.size(T.line_chars(F.col("text"))), F.length("text") - 1, agree)
    routed = L.complete_lines(fx.ocr_lines(spark, sf)).select("image_id", route.alias("route"))
    return routed.groupBy("image_id").agg(
        F.count_if(F.col("route") == "free").alias("n_free"), F.count_if(F.col("route") == "guided").alias("n_guided"),
    ).withColumn("outcome", A.image_outcome(F.col("n_free"), F.col("n_guided")))


# Search of query bitmaps over template bitmaps given as px(k, id, y, x, ink), k being 'q' or 't'.
_BITMAP_SEARCH = """w AS (SELECT k, id, sum(CASE WHEN ink = 1 THEN 1::HUGEINT << (63 - y * 8 - x)::INT ELSE 0 END)::HUGEINT AS w FROM px GROUP BY k, id),
d AS (SELECT a.k, a.id, a.y, a.x,
        sqrt(min(CASE WHEN b.ink = 1 THEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) END))
        - sqrt(min(CASE WHEN b.ink = 0 THEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) END)) AS f
      FROM px a JOIN px b ON a.k = b.k AND a.id = b.id GROUP BY a.k, a.id, a.y, a.x),
sdf AS (SELECT k, id, y, x, f / stddev_pop(f) OVER (PARTITION BY k, id) AS v FROM d),
qf AS (SELECT id, list(v - m ORDER BY y, x) AS f FROM (SELECT *, avg(v) OVER (PARTITION BY k, id) AS m FROM sdf WHERE k = 'q') GROUP BY id),
moved AS (SELECT g.id, dy, dx, list(coalesce(s.v, 0) ORDER BY g.y, g.x) AS f, sum(coalesce(s.v, 0)) AS t
          FROM (SELECT * FROM px, range(-2, 3) u(dy), range(-2, 3) v(dx) WHERE k = 't') g
          LEFT JOIN sdf s ON s.k = 't' AND s.id = g.id AND s.y = g.y - dy AND s.x = g.x - dx GROUP BY g.id, dy, dx),
gr AS (SELECT p.k, p.id, p.y, p.x,
        CASE p.x WHEN 0 THEN r.ink - p.ink WHEN 7 THEN p.ink - l.ink ELSE (r.ink - l.ink) / 2 END::DOUBLE AS gx,
        CASE p.y WHEN 0 THEN n.ink - p.ink WHEN 7 THEN p.ink - u.ink ELSE (n.ink - u.ink) / 2 END::DOUBLE AS gy
      FROM px p LEFT JOIN px l ON l.k = p.k AND l.id = p.id AND l.y = p.y AND l.x = p.x - 1
      LEFT JOIN px r ON r.k = p.k AND r.id = p.id AND r.y = p.y AND r.x = p.x + 1
      LEFT JOIN px u ON u.k = p.k AND u.id = p.id AND u.x = p.x AND u.y = p.y - 1
      LEFT JOIN px n ON n.k = p.k AND n.id = p.id AND n.x = p.x AND n.y = p.y + 1),
bins AS (SELECT k, id, (y // 4 * 2 + x // 4) * 8
        + least(trunc(((atan2(gy, gx)::FLOAT + pi()::FLOAT)::FLOAT % pi()::FLOAT)::FLOAT / (pi() / 8)::FLOAT), 7)::BIGINT AS pos,
        sqrt(gx * gx + gy * gy) AS m FROM gr),
hist AS (SELECT b.k, b.id, r.pos, coalesce(sum(m) FILTER (b.pos = r.pos), 0) AS m FROM bins b, range(0, 32) r(pos) GROUP BY b.k, b.id, r.pos),
hv AS (SELECT k, id, list(m ORDER BY pos) AS h FROM hist GROUP BY k, id),
coarse AS (SELECT q.id AS mark_id, t.id, bit_count(q.w & t.w) / bit_count(q.w | t.w) AS iou FROM w q JOIN w t ON q.k = 'q' AND t.k = 't'
           QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY bit_count(q.w & t.w) / bit_count(q.w | t.w) DESC, t.id) <= 10),
ncc AS (SELECT mark_id, c.id, iou, greatest(max(list_dot_product(q.f, m.f)
          / sqrt(list_dot_product(q.f, q.f) * (list_dot_product(m.f, m.f) - m.t * m.t / 64))), 0) AS ncc
        FROM coarse c JOIN qf q ON q.id = mark_id JOIN moved m ON m.id = c.id GROUP BY mark_id, c.id, iou),
fused AS (SELECT mark_id, n.id, iou, 0.65 * least(ncc, 1) + 0.35 * least(list_dot_product(a.h, b.h)
            / sqrt(list_dot_product(a.h, a.h) * list_dot_product(b.h, b.h)), 1) AS score
          FROM ncc n JOIN hv a ON a.k = 'q' AND a.id = mark_id JOIN hv b ON b.k = 't' AND b.id = n.id)"""

_DRAWN = """bm AS (SELECT 'q' AS k, mark_id AS id, field FROM crop UNION ALL SELECT 't', font_id * 5 + ascii(char) - 97, field FROM tpl),
drawn AS (SELECT k, id, i // 8 AS y, i % 8 AS x, (field[i + 1] > 0.06::DOUBLE OR i >= 56)::INT AS ink FROM bm, range(0, 64) r(i)),
"""

_C7 = fx.with_views("glyphs", "features") + "," + _DRAWN + "px AS (SELECT * FROM drawn),\n" + _BITMAP_SEARCH + """
SELECT mark_id, row_number() OVER (PARTITION BY mark_id ORDER BY round(score, 9) DESC, id) - 1 AS rank, id // 5 AS font_id,
       chr((97 + id % 5)::INT) AS char, round(iou, 6) AS iou, round(score, 6) AS score FROM fused"""


# Line images side by side from their glyphs, cut into segments, fitted, searched and voted on.
_UNDETECTED = fx.with_views("glyphs", "features").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _DRAWN + """
dark AS (SELECT c.request_id AS line_id, d.y, d.x + 10 * (ascii(c.char) - 97) AS x, d.ink
         FROM drawn d JOIN crop c ON d.k = 'q' AND c.mark_id = d.id
         UNION ALL SELECT DISTINCT c.request_id, y, 10 * g + 8 + s, 0 FROM crop c, range(0, 8) a(y), range(0, 4) b(g), range(0, 2) e(s)),
img AS (SELECT line_id, y, x, CASE WHEN 2 * sum(ink) OVER (PARTITION BY line_id) <= 384 THEN ink ELSE 1 - ink END AS ink FROM dark),
cols AS (SELECT line_id, x, min(y) AS y0, max(y) AS y1, 48::BIGINT AS width FROM img WHERE ink = 1 GROUP BY line_id, x),
runs AS (SELECT line_id, width, min(x) AS x0, max(x) + 1 AS x1, min(y0) AS y0, max(y1) AS y1
         FROM (SELECT *, x - row_number() OVER (PARTITION BY line_id ORDER BY x) AS isle FROM cols) GROUP BY line_id, width, isle),
""" + _FOLD + """,
whole AS (SELECT p.line_id, p.x0, p.x1, max(r.y1) - min(r.y0) + 1 AS h
          FROM parts p JOIN runs r ON r.line_id = p.line_id AND r.x0 >= p.x0 AND r.x1 <= p.x1 GROUP BY ALL),
cut AS (SELECT line_id, x0 + (x1 - x0) * i // n AS x0, x0 + (x1 - x0) * (i + 1) // n AS x1
        FROM (SELECT *, greatest(ceil((x1 - x0) / greatest(h * 1.35::DOUBLE, 1)), 1)::BIGINT AS n FROM whole), range(0, n) r(i)),
box AS (SELECT c.line_id, c.x0, x1 - c.x0 AS w, min(y) AS y0, max(y) - min(y) + 1 AS h,
               row_number() OVER (PARTITION BY c.line_id ORDER BY c.x0) AS seg_no
        FROM cut c JOIN img m ON m.line_id = c.line_id AND m.ink = 1 AND m.x >= c.x0 AND m.x < c.x1 GROUP BY c.line_id, c.x0, x1),
fit AS (SELECT *, line_id * 100 + seg_no AS id, greatest(round_even(h * least(8 / h, 8 / w), 0), 1)::BIGINT AS nh,
               greatest(round_even(w * least(8 / h, 8 / w), 0), 1)::BIGINT AS nw FROM box),
sizes AS (SELECT h AS n_in, nh AS n_out FROM fit UNION SELECT w, nw FROM fit),""" + _COEF + """,
hp AS (SELECT f.id, m.y - f.y0 AS y, o AS x, nh, nw, h, least(greatest(floor((sum(ink * 255 * k) + 2097152) / 4194304), 0), 255) AS v
       FROM fit f JOIN img m ON m.line_id = f.line_id AND m.x >= f.x0 AND m.x < f.x0 + f.w AND m.y >= f.y0 AND m.y < f.y0 + f.h
       JOIN coef ON n_in = w AND n_out = nw AND i = m.x - f.x0 GROUP BY ALL),
vp AS (SELECT id, o + (8 - nh) // 2 AS y, x + (8 - nw) // 2 AS x, (floor((sum(v * k) + 2097152) / 4194304) > 32)::INT AS ink
       FROM hp JOIN coef ON n_in = h AND n_out = nh AND i = y GROUP BY id, o, x, nh, nw),
px AS (SELECT * FROM drawn WHERE k = 't'
       UNION ALL SELECT 'q', f.id, y, x, coalesce(ink, 0) FROM (SELECT fit.id, y, x FROM fit, range(0, 8) a(y), range(0, 8) b(x)) f
       LEFT JOIN vp USING (id, y, x)),
""" + _BITMAP_SEARCH + """,
seen AS (SELECT mark_id // 100 AS request_id, id // 5 AS font_id, score FROM fused
         QUALIFY row_number() OVER (PARTITION BY mark_id ORDER BY round(score, 9) DESC, id) = 1 AND score >= 0.6),
same(font_id, group_id) AS (VALUES (0, 0), (1, 0), (2, 2), (3, 2)),
counted AS (SELECT request_id, coalesce(group_id, s.font_id) AS group_id, avg(score) AS score, count(*) AS votes
            FROM seen s LEFT JOIN same USING (font_id) GROUP BY ALL),
best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY votes DESC, score DESC, group_id) = 1)
SELECT r.request_id AS image_id, CASE WHEN score IS NULL THEN 'none' ELSE 'mixed' END AS outcome,
       CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'free' WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict,
       round(coalesce(score, 0), 6) AS confidence, group_id AS best_font, coalesce(votes, 0) AS votes
FROM (SELECT DISTINCT request_id FROM crop) r LEFT JOIN best USING (request_id)"""


def _search_sets() -> str:
    """``_BITMAP_SEARCH`` with two kinds of coarse lists: ids under 2000000000 are searched over the whole index, the rest
    over the templates of their own character."""
    begin, end = _BITMAP_SEARCH.index("coarse AS ("), _BITMAP_SEARCH.index("ncc AS (")
    return _BITMAP_SEARCH[:begin] + """coarse AS MATERIALIZED (
  SELECT * FROM (SELECT q.id AS mark_id, t.id, bit_count(q.w & t.w) / bit_count(q.w | t.w) AS iou
                 FROM w q JOIN w t ON q.k = 'q' AND t.k = 't' AND q.id < 2000000000
                 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY bit_count(q.w & t.w) / bit_count(q.w | t.w) DESC, t.id) <= 10)
  UNION ALL
  SELECT * FROM (SELECT q.id AS mark_id, t.id, bit_count(q.w & t.w) / bit_count(q.w | t.w) AS iou
                 FROM w q JOIN mark g ON q.k = 'q' AND q.id = 2000000000 + g.line_id * 100 + g.seg_no
                 JOIN w t ON t.k = 't' AND t.id % 5 = ascii(g.char) - 97
                 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY bit_count(q.w & t.w) / bit_count(q.w | t.w) DESC, t.id) <= 50)),
""" + _BITMAP_SEARCH[end:]


# The automatic flow as one statement. Query bitmaps come in three sets by id: segments read without their text, marks
# for the label check (from 1000000000), and marks matched under their label (from 2000000000).
_FLOW = _UNDETECTED[:_UNDETECTED.index("box AS (SELECT c.line_id")] + """
fbox AS (SELECT c.line_id, c.line_id * 100 + row_number() OVER (PARTITION BY c.line_id ORDER BY c.x0) AS id, c.x0, x1 - c.x0 AS w, min(y) AS y0, max(y) - min(y) + 1 AS h
         FROM cut c JOIN img m ON m.line_id = c.line_id AND m.ink = 1 AND m.x >= c.x0 AND m.x < c.x1 GROUP BY c.line_id, c.x0, x1),
lines AS (SELECT request_id AS line_id, true_font AS image_id, mode AS line_no, (request_id * 7 % 100) / 100.0::DOUBLE AS score, 8 * (40 + request_id % 9) AS area,
            CASE WHEN request_id % 7 = 3 THEN 'abdce' WHEN request_id % 11 = 5 THEN 'abcd' WHEN request_id % 13 = 6 THEN '-,.' ELSE 'abcde' END AS text
          FROM (SELECT DISTINCT request_id, true_font, mode FROM crop)),
large AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, line_no) AS line_rank FROM lines QUALIFY line_rank <= 3),
kept AS (SELECT line_id, x0, x1, row_number() OVER (PARTITION BY line_id ORDER BY x0) AS n
         FROM (SELECT *, list_sort(list(x1 - x0) OVER (PARTITION BY line_id)) AS ws FROM runs WHERE x1 - x0 >= 5 OR x1 = width)
         WHERE x1 - x0 > 0.35::DOUBLE * ws[len(ws) // 2 + 1]),
chars AS (SELECT line_id, generate_subscripts(u, 1) AS n, unnest(u) AS char
          FROM (SELECT line_id, regexp_extract_all(substr(text, 1, 20), '[\\p{L}\\p{N}]') AS u FROM large)),
plan AS (SELECT l.*, coalesce(c.n, 0) AS n_chars, coalesce(k.n, 0) AS n_segs FROM large l
         LEFT JOIN (SELECT line_id, count(*) AS n FROM chars GROUP BY 1) c USING (line_id) LEFT JOIN (SELECT line_id, count(*) AS n FROM kept GROUP BY 1) k USING (line_id)),
mark AS MATERIALIZED (
  SELECT k.line_id, k.n - 1 AS seg_no, c.char, k.x0, k.x1, min(m.y) AS y0, max(m.y) AS y1
  FROM kept k JOIN chars c ON c.line_id = k.line_id AND c.n = k.n JOIN plan p ON p.line_id = k.line_id AND p.score >= 0.6 AND p.n_chars > 0 AND p.n_segs = p.n_chars
  JOIN img m ON m.line_id = k.line_id AND m.ink = 1 AND m.x >= k.x0 AND m.x < k.x1 GROUP BY ALL),
own AS (SELECT m.line_id * 100 + m.seg_no AS mid, d.y, d.x, d.ink, sum(d.ink) OVER own AS n_dark, count(*) OVER own AS n_all
        FROM mark m JOIN dark d ON d.line_id = m.line_id AND d.x >= m.x0 AND d.x < m.x1 AND d.y BETWEEN m.y0 AND m.y1
        WINDOW own AS (PARTITION BY m.line_id, m.seg_no)),
mink AS MATERIALIZED (SELECT mid, y, x, CASE WHEN 2 * n_dark <= n_all THEN ink ELSE 1 - ink END AS ink FROM own),
mbox AS (SELECT mid, min(x) AS a0, max(x) + 1 - min(x) AS aw, min(x) FILTER (ink = 1) AS x0, max(x) FILTER (ink = 1) + 1 - min(x) FILTER (ink = 1) AS w,
           min(y) FILTER (ink = 1) AS y0, max(y) FILTER (ink = 1) + 1 - min(y) FILTER (ink = 1) AS h FROM mink GROUP BY mid HAVING sum(ink) > 0),
boxes AS (SELECT id, x0, w, y0, h FROM fbox UNION ALL SELECT 1000000000 + mid, a0, aw, y0, h FROM mbox UNION ALL SELECT 2000000000 + mid, x0, w, y0, h FROM mbox),
source AS (SELECT f.id, m.y, m.x, m.ink FROM fbox f JOIN img m ON m.line_id = f.line_id
           UNION ALL SELECT 1000000000 + mid, y, x, ink FROM mink UNION ALL SELECT 2000000000 + mid, y, x, ink FROM mink),
fit AS (SELECT *, greatest(round_even(h * least(8 / h, 8 / w), 0), 1)::BIGINT AS nh, greatest(round_even(w * least(8 / h, 8 / w), 0), 1)::BIGINT AS nw FROM boxes),
sizes AS (SELECT h AS n_in, nh AS n_out FROM fit UNION SELECT w, nw FROM fit),""" + _COEF + """,
hp AS (SELECT f.id, m.y - f.y0 AS y, o AS x, nh, nw, h, least(greatest(floor((sum(ink * 255 * k) + 2097152) / 4194304), 0), 255) AS v
       FROM fit f JOIN source m ON m.id = f.id AND m.x >= f.x0 AND m.x < f.x0 + f.w AND m.y >= f.y0 AND m.y < f.y0 + f.h
       JOIN coef ON n_in = w AND n_out = nw AND i = m.x - f.x0 GROUP BY ALL),
vp AS (SELECT id, o + (8 - nh) // 2 AS y, x + (8 - nw) // 2 AS x, (floor((sum(v * k) + 2097152) / 4194304) > 32)::INT AS ink
       FROM hp JOIN coef ON n_in = h AND n_out = nh AND i = y GROUP BY id, o, x, nh, nw),
px AS MATERIALIZED (SELECT * FROM drawn WHERE k = 't'
       UNION ALL SELECT 'q', f.id, y, x, coalesce(ink, 0) FROM (SELECT fit.id, y, x FROM fit, range(0, 8) a(y), range(0, 8) b(x)) f
       LEFT JOIN vp USING (id, y, x)),
""" + _search_sets() + """,
found AS MATERIALIZED (SELECT * FROM fused),
best AS (SELECT mark_id, id // 5 AS font_id, chr((97 + id % 5)::INT) AS char, score FROM found WHERE mark_id < 2000000000
         QUALIFY row_number() OVER (PARTITION BY mark_id ORDER BY round(score, 9) DESC, id) = 1),
agree AS (SELECT m.line_id, bool_and(coalesce(b.char = m.char AND b.score >= 0.6, false)) AS agree
          FROM mark m LEFT JOIN best b ON b.mark_id = 1000000000 + m.line_id * 100 + m.seg_no GROUP BY m.line_id),
routed AS MATERIALIZED (
  SELECT p.image_id, p.line_id, p.line_rank, CASE WHEN p.score < 0.6 THEN 'free' WHEN n_chars = 0 THEN 'skip' WHEN n_segs <> n_chars THEN 'free'
           WHEN NOT coalesce(agree, false) THEN 'free' ELSE 'guided' END AS route FROM plan p LEFT JOIN agree USING (line_id))
"""
_ROUTES = _FLOW + "SELECT image_id, line_id::VARCHAR AS line_id, line_rank, route FROM routed"
_VERDICTS = _FLOW + """, same(font_id, group_id) AS (VALUES (0, 0), (1, 0), (2, 2), (3, 2)),
tops AS (SELECT r.image_id, f.mark_id, f.id // 5 AS font_id, f.score, row_number() OVER (PARTITION BY f.mark_id ORDER BY f.score DESC, f.id) - 1 AS rank
         FROM found f JOIN routed r ON f.mark_id >= 2000000000 AND r.line_id = (f.mark_id - 2000000000) // 100 AND r.route = 'guided' QUALIFY rank < 5),
seen AS (SELECT r.image_id, b.font_id, b.score, 0 AS late FROM best b JOIN routed r ON b.mark_id < 1000000000 AND r.line_id = b.mark_id // 100 AND r.route = 'free' WHERE b.score >= 0.6
         UNION ALL SELECT image_id, font_id, score, 1 FROM tops WHERE rank = 0 AND score >= 0.6),
image AS (SELECT l.image_id, CASE WHEN coalesce(n_free, 0) > 0 THEN 'mixed' WHEN coalesce(n_marks, 0) > 0 THEN 'guided' ELSE 'none' END AS outcome
          FROM (SELECT DISTINCT image_id FROM lines) l LEFT JOIN (SELECT image_id, count(*) AS n_free FROM seen WHERE late = 0 GROUP BY 1) USING (image_id)
          LEFT JOIN (SELECT r.image_id, count(*) AS n_marks FROM mark m JOIN routed r ON r.line_id = m.line_id AND r.route = 'guided' GROUP BY 1) USING (image_id)),
counted AS (SELECT image_id, coalesce(group_id, s.font_id) AS group_id, avg(score) AS score, count(*) AS votes
            FROM seen s LEFT JOIN same USING (font_id) JOIN image USING (image_id) WHERE outcome = 'mixed' GROUP BY ALL),
weighted AS (SELECT image_id, coalesce(group_id, t.font_id) AS group_id, avg(score * (1 - 0.15::DOUBLE * rank)) AS score, count(*) AS votes
             FROM tops t LEFT JOIN same USING (font_id) JOIN image USING (image_id) WHERE outcome = 'guided' GROUP BY ALL),
first AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, score DESC, group_id) = 1
          UNION ALL SELECT * FROM weighted WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, group_id) = 1)
SELECT i.image_id, outcome, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'free' WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict,
       round(CASE WHEN outcome = 'guided' THEN round(coalesce(score, 0), 4) ELSE coalesce(score, 0) END, 6) AS confidence, group_id AS best_font, coalesce(votes, 0) AS votes
FROM image i LEFT JOIN first USING (image_id)"""


@query("C3 C6 J7", _ROUTES)
def line_label_checks(spark, sf):
    """Routes of all lines, including the check of every label against the whole index."""
    return A.auto_match(fx.line_images(spark, sf), _index(spark, sf), fx.groups(spark, sf), SHAPE)["lines"]


@query("C7", _C7)
def text_free_search(spark, sf):
    """Whole-index search of every glyph bitmap by field and orientation with a shift search."""
    g = fx.raw_crops(spark, sf)
    from typetrace.functions.bits import pack_words
    bitmaps = g.select("mark_id", pack_words(fx.drawn("field"), fx.WORDS).alias("bits"))
    return A.text_free_search(bitmaps, _index(spark, sf), SHAPE).select(
        "mark_id", "rank", "font_id", "char", F.round("iou", 6).alias("iou"), F.round("score", 6).alias("score"))


@query("C11 C10", _VERDICTS)
def auto_verdicts(spark, sf):
    out = A.auto_match(fx.line_images(spark, sf), _index(spark, sf), fx.groups(spark, sf), SHAPE)["images"]
    return out.drop("note").withColumn("confidence", F.round("confidence", 6))


_SEEN = """, same(font_id, group_id) AS (VALUES (0, 0), (1, 0), (2, 2), (3, 2)),
tops AS (SELECT r.image_id, f.mark_id, m.char, line_rank, m.seg_no, f.id // 5 AS font_id, f.score, row_number() OVER (PARTITION BY f.mark_id ORDER BY f.score DESC, f.id) - 1 AS rank
         FROM mark m JOIN routed r ON r.line_id = m.line_id AND r.route = 'guided' JOIN found f ON f.mark_id = 2000000000 + m.line_id * 100 + m.seg_no QUALIFY rank < 5),
seen AS MATERIALIZED (
  SELECT image_id, coalesce(group_id, s.font_id) AS group_id, score, char, late * 1000000 + line_rank * 1000 + seg_no AS ord, late FROM (
    SELECT r.image_id, b.font_id, b.char, b.score, 0 AS late, line_rank, b.mark_id % 100 AS seg_no FROM best b JOIN routed r ON b.mark_id < 1000000000 AND r.line_id = b.mark_id // 100 AND r.route = 'free' WHERE b.score >= 0.6
    UNION ALL SELECT image_id, font_id, char, score, 1, line_rank, seg_no FROM tops WHERE rank = 0 AND score >= 0.6) s LEFT JOIN same USING (font_id)),
freed AS (SELECT DISTINCT image_id FROM seen WHERE late = 0),
counted AS (SELECT image_id, group_id, avg(score) AS score, count(*) AS votes, arg_min(char, ord) AS char_matched FROM seen SEMI JOIN freed USING (image_id) GROUP BY ALL),
every AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, score DESC, group_id) AS rank FROM counted),
weighted AS (SELECT image_id, coalesce(group_id, t.font_id) AS group_id, avg(score * (1 - 0.15::DOUBLE * rank)) AS score, count(*) AS votes
             FROM tops t LEFT JOIN same USING (font_id) WHERE image_id NOT IN (SELECT image_id FROM freed) GROUP BY ALL)
"""


@query("C11 J3", _FLOW + _SEEN + """SELECT c.image_id, group_id, rank, votes, char_matched, round(score, 6) AS score, coalesce(p_name, group_id::VARCHAR) AS name
FROM (SELECT image_id, group_id, rank, votes, char_matched, score FROM every WHERE rank <= 5
      UNION ALL SELECT image_id, group_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, group_id) AS rank, votes, NULL, score
      FROM weighted WHERE score >= 0.55 QUALIFY rank <= 5) c LEFT JOIN part ON p_partkey = group_id""")
def auto_candidates(spark, sf):
    meta = fx.font_rows(spark, sf).withColumn("source_url", F.concat(F.lit("http://"), "style"))
    out = A.auto_match(fx.line_images(spark, sf), _index(spark, sf), fx.groups(spark, sf), SHAPE, fonts=meta)["candidates"]
    return out.select("image_id", "group_id", "rank", "votes", "char_matched", F.round("score", 6).alias("score"), "name")


@query("C8 C11", _FLOW + """, listed AS (
  SELECT mark_id, string_agg(id // 5 || ':' || chr((97 + id % 5)::INT), ',' ORDER BY n) AS top
  FROM (SELECT mark_id, id, row_number() OVER (PARTITION BY mark_id ORDER BY round(score, 9) DESC, id) AS n FROM found WHERE mark_id < 1000000000 QUALIFY n <= 3) GROUP BY 1)
SELECT r.image_id, r.line_id::VARCHAR AS line_id, (b.mark_id % 100 - 1)::INT AS seg_no, b.char, l.top
FROM best b JOIN routed r ON b.mark_id < 1000000000 AND r.line_id = b.mark_id // 100 AND r.route = 'free' JOIN listed l USING (mark_id) WHERE b.score >= 0.6""")
def auto_evidence(spark, sf):
    """First three templates of every segment that was read without its text."""
    out = A.auto_match(fx.line_images(spark, sf), _index(spark, sf), fx.groups(spark, sf), SHAPE)["segments"]
    one = F.transform("top", lambda c: F.concat_ws(":", c["font_id"], c["char"]))
    return out.select("image_id", "line_id", "seg_no", "char", F.array_join(one, ",").alias("top"))


@query("C11", _FLOW + _SEEN + """, used AS (SELECT s.image_id, char, min(rank * 10000000 + ord) AS place FROM seen s JOIN every e ON e.image_id = s.image_id AND e.group_id = s.group_id GROUP BY ALL)
SELECT image_id, string_agg(char, '' ORDER BY place) AS chars_used FROM used GROUP BY image_id""")
def auto_characters(spark, sf):
    out = A.auto_match(fx.line_images(spark, sf), _index(spark, sf), fx.groups(spark, sf), SHAPE)["chars_used"]
    return out.select("image_id", F.array_join("chars_used", "").alias("chars_used"))


@query("C12", """SELECT vec_id AS image_id, 'no text found in the image' AS error FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT image_id, 'no text found in the image' FROM (
  SELECT vec_id AS image_id, least(greatest(floor((unnest(embedding)::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 256), 0), 255)::INT AS level FROM embeddings WHERE vec_id % 3 <> 0)
GROUP BY image_id HAVING min(level) = max(level)""")
def blank_images(spark, sf):
    """Every third image is plain paper."""
    paper = F.transform("px", lambda _: F.lit(200))
    images = fx.glyph_images(spark, sf).withColumn("px", F.when(F.col("image_id") % 3 == 0, paper).otherwise(F.col("px")))
    return A.blank_images(images)


@query("P6 S7", fx.with_views("pixels") + """,
box AS (SELECT image_id, (image_id % 5) - 1.5::DOUBLE AS ax, (image_id % 3) - 0.5::DOUBLE AS ay, (image_id % 5) + 3.75::DOUBLE AS bx, (image_id % 3) + image_id % 7 + 0.25::DOUBLE AS yy
        FROM (SELECT DISTINCT image_id FROM px) WHERE image_id % 11 <> 4 AND image_id % 13 <> 5),
w AS (SELECT image_id, greatest(trunc(ax), 0) AS x0, greatest(trunc(ay), 0) AS y0, least(trunc(bx), 8) AS x1, least(trunc(yy), 8) AS y1 FROM box)
SELECT w.image_id, (y1 - y0)::INT AS height, (x1 - x0)::INT AS width, string_agg(level, ' ' ORDER BY y, x) AS px
FROM w JOIN px ON px.image_id = w.image_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL""")
def line_crops(spark, sf):
    """Lines cut from their images: incomplete rows and empty windows give none."""
    k = F.col("image_id")
    images = fx.glyph_images(spark, sf)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ax, ay, bx, by = k % 5 - 1.5, k % 3 - 0.5, k % 5 + 3.75, k % 3 + k % 7 + 0.25
    lines = images.select("image_id", F.when(k % 11 == 4, None).otherwise(F.array(point(ax, ay), point(bx, ay), point(bx, by), point(ax, by))).alias("box"),
                          F.lit("t").alias("text"), F.when(k % 13 == 5, None).otherwise(F.lit(0.9)).alias("score"))
    return A.cut_lines(images, lines).select("image_id", "height", "width", F.array_join(F.col("px").cast("array<string>"), " ").alias("px"))


@query("C8 C12", _UNDETECTED)
def undetected_image_verdicts(spark, sf):
    """Every line image on its own, as if nothing had been detected in it."""
    images = fx.line_images(spark, sf).select(
        F.col("line_id").cast("bigint").alias("image_id"), "height", "width", "px")
    out = A.auto_match(A.whole_image_lines(images), _index(spark, sf), fx.groups(spark, sf), SHAPE)["images"]
    return out.drop("note").withColumn("confidence", F.round("confidence", 6))
