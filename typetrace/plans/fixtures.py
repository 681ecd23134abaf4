"""Engine inputs derived from the given tables, as DataFrames and as the same SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from typetrace.operators import search
from typetrace.session import spread

SIDE = 8          # the embedding table holds 8 x 8 fields
WORDS = 1         # which pack into one word
MODES = ((0, 0.0), (1, 0.35), (2, 0.7), (3, 1.1))   # (mode, strength of the disturbance)
LISTED_SIZE = 40  # catalogue rows up to this size are the white list


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def glyph_rows(embeddings: DataFrame) -> DataFrame:
    """One 8 x 8 field per (font, character)."""
    return embeddings.select(
        "vec_id",
        F.expr("vec_id div 5").alias("font_id"),
        F.expr("char(97 + vec_id % 5)").alias("char"),
        F.col("embedding").cast("array<double>").alias("field"),
    )


def glyphs(spark: SparkSession, sf: str) -> DataFrame:
    return glyph_rows(spread(table(spark, sf, "embeddings")))


def listed_fonts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(F.col("p_size") <= LISTED_SIZE).select(
        F.col("p_partkey").alias("font_id")
    )


def templates(spark: SparkSession, sf: str) -> DataFrame:
    rows = glyphs(spark, sf).join(listed_fonts(spark, sf), "font_id")
    return search.with_features(rows, "field", WORDS)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0L, 0L), (1L, 0L), (2L, 2L), (3L, 2L) AS t(font_id, group_id)")


def raw_crops(spark: SparkSession, sf: str) -> DataFrame:
    return disturbed(glyphs(spark, sf), glyphs(spark, sf))


def disturbed(base: DataFrame, others: DataFrame) -> DataFrame:
    """Every glyph in every mode: the glyph plus a multiple of another row's field."""
    n = others.count()
    other = others.select(F.col("vec_id").alias("other_id"), F.col("field").alias("other"))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(a).alias("alpha")) for m, a in MODES])
    return (
        base.withColumn("other_id", (F.col("vec_id") * 7 + 3) % n)
        .join(other, "other_id")
        .select("vec_id", "font_id", "char", "field", "other", F.inline(modes))
        .select(
            (F.col("vec_id") * 4 + F.col("mode")).alias("mark_id"),
            (F.col("font_id") * 4 + F.col("mode")).alias("request_id"),
            F.col("font_id").alias("true_font"),
            "mode",
            "char",
            F.zip_with("field", "other", lambda a, b: a + F.col("alpha") * b).alias("field"),
        )
    )


def crops(spark: SparkSession, sf: str) -> DataFrame:
    return search.with_features(raw_crops(spark, sf), "field", WORDS)


SQL = {}

SQL["glyphs"] = """glyphs AS (
  SELECT vec_id, vec_id // 5 AS font_id, chr((97 + vec_id % 5)::INT) AS char, embedding::DOUBLE[] AS field
  FROM embeddings)"""

SQL["features"] = """tpl AS (
  SELECT g.font_id, g.char, g.field FROM glyphs g JOIN part p ON p.p_partkey = g.font_id AND p.p_size <= 40),
modes(mode, alpha) AS (VALUES (0, 0.0::DOUBLE), (1, 0.35::DOUBLE), (2, 0.7::DOUBLE), (3, 1.1::DOUBLE)),
crop AS (
  SELECT a.vec_id * 4 + m.mode AS mark_id, a.font_id * 4 + m.mode AS request_id, a.font_id AS true_font,
         m.mode, a.char,
         list_transform(range(1, 65), lambda i: a.field[i] + m.alpha * b.field[i]) AS field
  FROM glyphs a
  JOIN glyphs b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)
  CROSS JOIN modes m),
crop_f AS (
  SELECT *, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN field[i + 1] > 0
              THEN 1::HUGEINT << (63 - i)::INT ELSE 0::HUGEINT END)) AS w,
         list_transform(field, lambda v: v - list_avg(field)) AS cf FROM crop),
tpl_f AS (
  SELECT *, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN field[i + 1] > 0
              THEN 1::HUGEINT << (63 - i)::INT ELSE 0::HUGEINT END)) AS w,
         list_transform(field, lambda v: v - list_avg(field)) AS cf FROM tpl)"""

SQL["search"] = """pairs AS (
  SELECT c.request_id, c.mark_id, c.char, t.font_id, c.true_font, c.mode,
         CASE WHEN bit_count(c.w | t.w) > 0 THEN bit_count(c.w & t.w) / bit_count(c.w | t.w) ELSE 0.0 END AS iou,
         c.field AS qf, t.field AS tf, c.cf AS qc, t.cf AS tc
  FROM crop_f c JOIN tpl_f t USING (char)),
coarse AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY iou DESC, font_id) AS coarse_rank FROM pairs
  QUALIFY coarse_rank <= 50),
scored AS (
  SELECT *, 0.65 * ncc + 0.35 * cosine AS score FROM (
    SELECT request_id, mark_id, char, font_id, true_font, mode, iou, coarse_rank,
      least(greatest(list_dot_product(qc, tc)
        / sqrt(list_dot_product(qc, qc) * list_dot_product(tc, tc)), 0.0), 1.0) AS ncc,
      least(greatest(list_dot_product(qf, tf)
        / sqrt(list_dot_product(qf, qf) * list_dot_product(tf, tf)), 0.0), 1.0) AS cosine
    FROM coarse)),
tops AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY score DESC, font_id) - 1 AS rank FROM scored
  QUALIFY rank < 5)"""

SQL["vote"] = """same(font_id, group_id) AS (VALUES (0, 0), (1, 0), (2, 2), (3, 2)),
voted AS (
  SELECT request_id, coalesce(group_id, t.font_id) AS group_id,
         avg(score * (1 - 0.15 * rank)) AS score, count(*) AS votes
  FROM tops t LEFT JOIN same s ON s.font_id = t.font_id
  GROUP BY ALL),
cands AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, group_id) AS rank
  FROM voted WHERE score >= 0.55 QUALIFY rank <= 5)"""


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


# ---- pixels, lines, boxes and catalogue rows -------------------------------------------------


def pixel_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row per pixel of every 8 x 8 glyph: ``image_id, y, x, ink, level``."""
    return (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("image_id"), F.posexplode(F.col("embedding").cast("array<double>")))
        .select(
            "image_id",
            F.expr("pos div 8").alias("y"),
            (F.col("pos") % 8).alias("x"),
            (F.col("col") > 0).cast("int").alias("ink"),
            level_of(F.col("col")).alias("level"),
        )
    )


def level_of(v):
    return F.least(F.greatest(F.floor((v + 0.6) / 1.2 * 256), F.lit(0)), F.lit(255)).cast("int")


def glyph_images(spark: SparkSession, sf: str) -> DataFrame:
    """The same glyphs as whole images: ``image_id, height, width, px``."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        F.transform(F.col("embedding").cast("array<double>"), level_of).alias("px"),
    )


def rgb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.floor("l_extendedprice") % 256).alias("r"),
        (F.floor(F.col("l_quantity") * 5) % 256).alias("g"),
        (F.floor(F.col("l_discount") * 2000 + F.col("l_tax") * 1000) % 256).alias("b"),
    )


def font_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue rows; the part names repeat, so family keys do too."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("font_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("license"),
        F.col("p_type").alias("style"),
        F.col("p_partkey").alias("file_pos"),
        F.col("p_size").alias("size"),
    )


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text of the benchmark and conversation tables under one key."""
    b = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("text_id"), "text")
    c = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("text_id"), "text"
    )
    return b.unionByName(c)


def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Detected lines of images with boxes, texts and scores, some of them incomplete."""
    k = F.col("p_partkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0 = (k * 31 % 400 - 20) + 0.75, (k % 4) * 40 - 10 + 0.25
    w, h = F.length("p_name") * 9 + k % 50, k % 20 + 4
    box = F.array(point(x0, y0), point(x0 + w, y0), point(x0 + w, y0 + h), point(x0, y0 + h))
    broken = F.array(F.get(box, F.lit(0)), F.get(box, F.lit(1)), F.lit(None).cast("struct<x:double,y:double>"),
                     F.get(box, F.lit(3)))
    return table(spark, sf, "part").select(
        F.expr("p_partkey div 4").alias("image_id"),
        (k % 4).alias("line_no"),
        F.when(k % 17 == 5, None).when(k % 19 == 7, broken).otherwise(box).alias("box"),
        F.when(k % 23 == 3, None).otherwise(F.col("p_name")).alias("text"),
        F.when(k % 13 == 6, None).otherwise((k * 7 % 100) / 100.0).alias("score"),
    )


SQL["pixels"] = """px AS (
  SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, (embedding[i + 1] > 0)::INT AS ink,
         least(greatest(floor((embedding[i + 1]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 256), 0), 255)::INT AS level
  FROM embeddings, range(0, 64) t(i))"""

SQL["rgb"] = """rgb AS (
  SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT % 256 AS r,
         floor(l_quantity * 5)::BIGINT % 256 AS g, floor(l_discount * 2000 + l_tax * 1000)::BIGINT % 256 AS b
  FROM lineitem)"""

SQL["texts"] = """texts AS (
  SELECT 'b' || item_id AS text_id, text FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"""

SQL["ocr"] = """ocr AS (
  SELECT p_partkey AS k, p_partkey // 4 AS image_id, p_partkey % 4 AS line_no,
         CASE WHEN p_partkey % 17 = 5 THEN NULL ELSE (p_partkey * 31 % 400 - 20) + 0.75::DOUBLE END AS x0,
         CASE WHEN p_partkey % 17 = 5 THEN NULL ELSE (p_partkey % 4) * 40 - 10 + 0.25::DOUBLE END AS y0,
         length(p_name) * 9 + p_partkey % 50 AS w, p_partkey % 20 + 4 AS h,
         NOT (p_partkey % 17 = 5 OR p_partkey % 19 = 7) AS whole_box,
         CASE WHEN p_partkey % 23 = 3 THEN NULL ELSE p_name END AS text,
         CASE WHEN p_partkey % 13 = 6 THEN NULL ELSE (p_partkey * 7 % 100) / 100.0::DOUBLE END AS score
  FROM part),
valid AS (SELECT * FROM ocr WHERE whole_box AND text IS NOT NULL AND score IS NOT NULL)"""


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole line of every document; a character stands for one column of its image."""
    line_id = F.concat_ws("/", "doc_id", "line_no")
    return (
        spread(table(spark, sf, "documents").select("doc_id", "text"))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select(line_id.alias("line_id"), "line", F.length("line").alias("width"))
    )


def text_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Inked columns of those lines: all but blanks, with a row extent from the character."""
    code = F.ascii("c")
    return (
        text_lines(spark, sf)
        .select("line_id", F.posexplode(F.split("line", "")).alias("x", "c"))
        .filter((F.col("c") != " ") & (F.col("c") != ""))
        .select("line_id", "x", (code % 5).alias("y0"), (code % 5 + code % 7).alias("y1"))
    )


def level_pixels(spark: SparkSession, sf: str, image: str) -> DataFrame:
    """Event values as levels of one image per ``image`` value."""
    return table(spark, sf, "events").select(
        F.col(image).alias("image_id"), F.least(F.floor("value"), F.lit(255)).alias("level")
    )


SQL["columns"] = """lines AS (
  SELECT doc_id || '/' || (i - 1) AS line_id, l[i] AS line, length(l[i]) AS width
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) r(i)),
cols AS (
  SELECT line_id, x - 1 AS x, c % 5 AS y0, c % 5 + c % 7 AS y1, width
  FROM (SELECT line_id, width, generate_subscripts(a, 1) AS x, unicode(unnest(a)) AS c, unnest(a) AS t
        FROM (SELECT line_id, width, string_split(line, '') AS a FROM lines)) WHERE t <> ' ' AND t <> ''),
runs AS (
  SELECT line_id, width, min(x) AS x0, max(x) + 1 AS x1, min(y0) AS y0, max(y1) AS y1
  FROM (SELECT *, x - row_number() OVER (PARTITION BY line_id ORDER BY x) AS isle FROM cols)
  GROUP BY line_id, width, isle),
segs AS (SELECT * FROM runs WHERE x1 - x0 >= 5 OR x1 = width),
kept AS (
  SELECT line_id, x0, x1, y0, y1 FROM (
    SELECT *, list_sort(list(x1 - x0) OVER (PARTITION BY line_id)) AS ws FROM segs)
  WHERE x1 - x0 > 0.35::DOUBLE * ws[len(ws) // 2 + 1])"""

SQL["levels"] = """lv AS (
  SELECT 'u' || user_id AS image_id, least(floor(value)::BIGINT, 255) AS level FROM events
  UNION ALL SELECT event_type, least(floor(value)::BIGINT, 255) FROM events)"""

SQL["otsu"] = """hist AS (SELECT image_id, level, count(*) AS n FROM lv GROUP BY ALL),
cum AS (
  SELECT image_id, level, sum(n) OVER u::DOUBLE AS b, sum(n) OVER a::DOUBLE AS t,
         sum(n * level) OVER u::DOUBLE AS mb, sum(n * level) OVER a::DOUBLE AS m
  FROM hist WINDOW u AS (PARTITION BY image_id ORDER BY level), a AS (PARTITION BY image_id)),
var AS (
  SELECT image_id, level, b * (t - b) * (mb / b - (m - mb) / (t - b)) * (mb / b - (m - mb) / (t - b)) AS v
  FROM cum WHERE t > b),
thr AS (
  SELECT i.image_id, coalesce(v.level, 0) AS threshold FROM (SELECT DISTINCT image_id FROM lv) i
  LEFT JOIN (SELECT image_id, level FROM var
             QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, level) = 1) v USING (image_id))"""


def drawn(field: str):
    """Ink of a glyph as it is drawn in a line: its strong pixels on a full base row, so that
    every glyph is one run of columns and ink stays the minority."""
    return F.transform(field, lambda v, i: ((v > 0.06) | (i >= SIDE * (SIDE - 1))).cast("int"))


def line_images(spark: SparkSession, sf: str) -> DataFrame:
    """One line image per font and mode: its five glyphs side by side with two blank columns.

    Every font is an image and every mode a line of it. Some texts carry a wrong label, some a
    label too few, and some scores are too low to be trusted. A character whose glyph is not there
    leaves its place blank, one without a field has its base row only, and a repeated one takes a place more.
    """
    gap = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda _: F.lit(255))
    unknown = F.transform(F.sequence(F.lit(1), F.lit(SIDE * SIDE)), lambda _: F.lit(None).cast("double"))
    level = F.transform(drawn(F.coalesce("field", unknown)), lambda v: 255 - F.coalesce(v, F.lit(0)) * 255)
    g = raw_crops(spark, sf).select("request_id", "true_font", "mode", "char", level.alias("px"))
    blank = F.transform(F.sequence(F.lit(1), F.lit(SIDE * SIDE)), lambda _: F.lit(255))
    letters = F.array(*[F.lit(c) for c in "abcde"])
    missing = F.transform(F.array_except(letters, F.col("g.char")), lambda c: F.struct(c.alias("char"), blank.alias("px")))
    whole = g.groupBy("request_id", "true_font", "mode").agg(F.collect_list(F.struct("char", "px")).alias("g")).withColumn(
        "g", F.sort_array(F.concat("g", missing)))
    row = lambda y: F.flatten(F.transform(
        "g", lambda c, i: F.concat(F.when(i > 0, gap).otherwise(F.array().cast("array<int>")),
                                   F.slice(c["px"], y * SIDE + 1, SIDE))))
    px = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), row))
    k = F.col("request_id")
    text = F.when(k % 7 == 3, "abdce").when(k % 11 == 5, "abcd").when(k % 13 == 6, "-,.").otherwise("abcde")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h, zero = 40 + k % 9, F.lit(8), F.lit(0)
    return whole.select(
        F.col("true_font").alias("image_id"), F.col("request_id").cast("string").alias("line_id"),
        F.col("mode").alias("line_no"), F.lit(SIDE).alias("height"), (F.size("g") * (SIDE + 2) - 2).alias("width"),
        px.alias("px"), text.alias("text"), ((k * 7 % 100) / 100.0).alias("score"),
        F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h)).alias("box"))


def bitmap_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index features of the listed glyph bitmaps, as the automatic flow searches them."""
    from typetrace.functions.bits import pack_words
    from typetrace.operators.fields import build_index

    rows = glyphs(spark, sf).join(listed_fonts(spark, sf), "font_id")
    return build_index(rows.select("font_id", "char", pack_words(drawn("field"), WORDS).alias("bits")), SIDE, SIDE, cells=2)
