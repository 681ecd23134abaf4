"""Row-wise operators: levels, boxes, sizes, texts, keys and verdict classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from typetrace.functions import boxes as B, pixels as P, scores as S, text as T
from typetrace.plans import fixtures as fx
from typetrace.plans.registry import query
from typetrace.sources import lines as L


@query("P1", fx.with_views("pixels") + """
SELECT image_id, string_agg(CASE WHEN level > 32 THEN '1' ELSE '0' END, '' ORDER BY y, x) AS bits
FROM px GROUP BY image_id""")
def threshold_pixels(spark, sf):
    return fx.glyph_images(spark, sf).select(
        "image_id", F.array_join(P.threshold(F.col("px")).cast("array<string>"), "").alias("bits")
    )


@query("P2 P3", fx.with_views("rgb") + """
SELECT l_orderkey, l_linenumber, (r + g + b) // 3 AS mean_gray,
       floor(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r)::BIGINT AS weighted_gray FROM rgb""")
def gray_levels(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return fx.rgb(spark, sf).select(
        "l_orderkey", "l_linenumber",
        P.channel_mean(r, g, b).alias("mean_gray"), P.weighted_gray(b, g, r).alias("weighted_gray"),
    )


@query("P23", fx.with_views("rgb") + """
SELECT l_orderkey, l_linenumber, least(r + g, 255) AS added, 255 - r AS inverted,
       CASE WHEN b > 127 THEN r & g ELSE 0 END AS masked
FROM rgb""")
def channel_arithmetic(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    mask = F.when(b > 127, F.lit(255)).otherwise(F.lit(0)).cast("bigint")
    return fx.rgb(spark, sf).select(
        "l_orderkey", "l_linenumber",
        P.saturating_add(r, g).alias("added"), P.invert(r).alias("inverted"),
        P.masked_and(r, g, mask).alias("masked"),
    )


@query("P4 P5", """
WITH b AS (SELECT event_id, event_id * 37 % 500 AS ax, event_id * 53 % 300 AS ay,
                  event_id * 37 % 500 + floor(value)::BIGINT % 60 - 30 AS bx,
                  event_id * 53 % 300 + user_id % 50 - 25 AS by_ FROM events)
SELECT event_id, least(ax, bx) AS x1, least(ay, by_) AS y1, greatest(ax, bx) AS x2, greatest(ay, by_) AS y2
FROM b WHERE abs(ax - bx) >= 8 AND abs(ay - by_) >= 8""")
def drawn_boxes(spark, sf):
    e = fx.table(spark, sf, "events")
    ax, ay = F.col("event_id") * 37 % 500, F.col("event_id") * 53 % 300
    bx, by = ax + F.floor("value") % 60 - 30, ay + F.col("user_id") % 50 - 25
    boxed = e.select("event_id", B.normalise_box(ax, ay, bx, by).alias("box"))
    return boxed.filter(B.usable_box(F.col("box"))).select("event_id", "box.*")


@query("S7 P6", fx.with_views("ocr") + """, w AS (
  SELECT image_id, line_no, greatest(trunc(x0)::BIGINT, 0) AS x0, greatest(trunc(y0)::BIGINT, 0) AS y0,
         least(trunc(x0 + w)::BIGINT, 360) AS x1, least(trunc(y0 + h)::BIGINT, 140) AS y1 FROM valid)
SELECT * FROM w WHERE x1 > x0 AND y1 > y0""")
def line_windows(spark, sf):
    win = B.crop_window(F.col("box"), F.lit(360), F.lit(140))
    return (
        L.complete_lines(fx.ocr_lines(spark, sf))
        .select("image_id", "line_no", win.alias("w"))
        .filter(~B.window_is_empty(F.col("w")))
        .select("image_id", "line_no", "w.*")
    )


@query("P7 A17", fx.with_views("texts") + """
SELECT text_id, len(u) AS n_usable, array_to_string(u, '') AS usable
FROM (SELECT text_id, regexp_extract_all(text, '[\\p{L}\\p{Nd}\\p{Nl}\\p{No}\\x{4e00}-\\x{9fff}]') AS u FROM texts)""")
def usable_characters(spark, sf):
    u = T.usable_chars(F.col("text"))
    return fx.text_rows(spark, sf).select(
        "text_id", F.size(u).cast("bigint").alias("n_usable"), F.array_join(u, "").alias("usable")
    )


@query("P8", fx.with_views("ocr") + """
SELECT image_id, line_no, array_to_string(regexp_extract_all(substr(text, 1, 20), '[\\p{L}\\p{N}]'), '') AS chars
FROM valid""")
def line_characters(spark, sf):
    return L.complete_lines(fx.ocr_lines(spark, sf)).select(
        "image_id", "line_no", F.array_join(T.line_chars(F.col("text")), "").alias("chars")
    )


@query("P9", """
SELECT event_id, CASE WHEN s >= 0.9::DOUBLE THEN 'free' WHEN s >= 0.75::DOUBLE THEN 'suspect' ELSE 'risky' END AS verdict
FROM (SELECT event_id, least(value / 100, 1) AS s FROM events)""")
def verdict_classes(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", S.verdict(F.least(F.col("value") / 100, F.lit(1.0))).alias("verdict")
    )


@query("P13 P14", """
WITH s AS (SELECT doc_id, n_chars % 3000 + 1 AS h, doc_id % 3000 + 1 AS w FROM documents),
c AS (SELECT *, CASE WHEN greatest(h, w) > 2200 THEN 2200::DOUBLE / greatest(h, w) ELSE 1.0::DOUBLE END AS ss,
             CASE WHEN greatest(h, w) > 1600 THEN 1600::DOUBLE / greatest(h, w) ELSE 1.0::DOUBLE END AS cs FROM s),
d AS (SELECT doc_id, greatest(round_even(h * ss, 0), 1)::BIGINT AS h, greatest(round_even(w * ss, 0), 1)::BIGINT AS w,
             greatest(round_even(h * cs, 0), 1)::BIGINT AS client_h, greatest(round_even(w * cs, 0), 1)::BIGINT AS client_w FROM c),
t AS (SELECT d.*, i AS attempt,
             (CASE WHEN greatest(h, w) < 400 THEN [2.5::DOUBLE, 2, 1.5, 1] ELSE [1.0::DOUBLE, 1.5, 2, 2.5] END)[i] AS scale
      FROM d, range(1, 5) r(i))
SELECT doc_id, client_h, client_w, attempt, scale, floor(h * scale)::BIGINT AS try_h, floor(w * scale)::BIGINT AS try_w,
       greatest(16, floor(greatest(floor(h * scale), floor(w * scale)) * 0.2::DOUBLE)::BIGINT) AS border
FROM t WHERE floor(h * scale) >= 8 AND floor(w * scale) >= 8""")
def detection_attempts(spark, sf):
    s = fx.table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 3000 + 1).alias("h"), (F.col("doc_id") % 3000 + 1).alias("w")
    )
    return (
        s.select("doc_id", B.capped_size(F.col("h"), F.col("w"), B.SERVER_EDGE).alias("size"),
                 B.capped_size(F.col("h"), F.col("w"), B.CLIENT_EDGE).alias("client"))
        .select("doc_id", "size", "client", F.posexplode(B.scale_ladder(F.col("size.h"), F.col("size.w"))))
        .select(
            "doc_id",
            F.col("client.h").alias("client_h"), F.col("client.w").alias("client_w"),
            (F.col("pos") + 1).alias("attempt"), F.col("col").alias("scale"),
            F.floor(F.col("size.h") * F.col("col")).alias("try_h"),
            F.floor(F.col("size.w") * F.col("col")).alias("try_w"),
        )
        .filter((F.col("try_h") >= B.MIN_BOX) & (F.col("try_w") >= B.MIN_BOX))
        .withColumn("border", B.border_for(F.col("try_h"), F.col("try_w")))
    )


_STYLE_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + f" THEN '{label}'"
    for label, words in T.STYLE_RULES
) + " ELSE 'mixed' END"
_NAMED = ("plain", *dict.fromkeys(w for _, words in T.STYLE_RULES for w in words))
_STYLE_WORDS = ", ".join(f"'{w}'" for w in _NAMED[1:])


@query("P16", f"""
WITH n AS (SELECT p_partkey AS font_id, p_name || ' ' || (['plain', {_STYLE_WORDS}])[p_partkey % {len(_NAMED)} + 1] AS name FROM part)
SELECT font_id, {_STYLE_SQL} AS style FROM n""")
def style_guesses(spark, sf):
    """Every word of every rule in turn, so that each rule, and its place among the others, shows."""
    word = F.get(F.array(*map(F.lit, _NAMED)), (F.col("font_id") % len(_NAMED)).cast("int"))
    name = F.concat("name", F.lit(" "), word)
    return fx.font_rows(spark, sf).select("font_id", T.guess_style(name).alias("style"))


_ENDS, _STARTS = (".ttf", ".OTF", ".ttc", ".dfont", ".woff", ".txt"), ("", "SF-", "sfsd", "SFCompact", "Webdings ", "Apple Symbols ", "New York ")


@query("P17", f"""
WITH f AS (SELECT p_partkey, ({list(_STARTS)})[p_partkey % {len(_STARTS)} + 1] || p_name AS name, ({list(_ENDS)})[p_partkey % {len(_ENDS)} + 1] AS ext FROM part)
SELECT p_partkey, name || ext AS file,
       lower(ext) IN ('.ttf', '.otf', '.ttc', '.dfont') AND NOT (contains(lower(name || ext), 'sf-') OR contains(lower(name || ext), 'sfsd')
         OR contains(lower(name || ext), 'sfcompact')) AS scanned,
       {" OR ".join(f"contains(lower(name), '{w}')" for w in T.SYMBOL_NAMES)} AS symbols FROM f""")
def scanned_files(spark, sf):
    """File names with every kind of ending, private prefixes and symbol fonts."""
    one_of = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words)).cast("int"))
    named = fx.table(spark, sf, "part").select("p_partkey", F.concat(one_of(_STARTS), "p_name").alias("name"), one_of(_ENDS).alias("ext"))
    file = F.concat("name", "ext")
    return named.select("p_partkey", file.alias("file"), T.scannable_file(file, F.col("ext")).alias("scanned"), T.is_symbol_name(F.col("name")).alias("symbols"))


@query("P18", "SELECT c_custkey, replace(lower(trim(' ' || c_name || ' ' || c_mktsegment || ' ')), ' ', '-') AS key FROM customer")
def family_keys(spark, sf):
    padded = F.concat(F.lit(" "), "c_name", F.lit(" "), "c_mktsegment", F.lit(" "))
    return fx.table(spark, sf, "customer").select("c_custkey", T.slug(padded).alias("key"))


@query("P19", """
SELECT p_partkey, CASE WHEN p_size > 20 THEN '/fonts/' || p_name || '.ttc' ELSE p_name || '.ttf' END AS path,
       CASE WHEN p_size > 20 THEN p_size END AS member FROM part""")
def font_locators(spark, sf):
    loc = F.when(
        F.col("p_size") > 20, F.concat(F.lit("system:/fonts/"), "p_name", F.lit(".ttc#"), F.col("p_size").cast("string"))
    ).otherwise(F.concat("p_name", F.lit(".ttf")))
    return fx.table(spark, sf, "part").select("p_partkey", T.split_locator(loc).alias("l")).select("p_partkey", "l.*")


@query("P21", """
SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'https://mirror.example/' || url ELSE url END AS url FROM pages""")
def mirrored_urls(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", T.via_mirror(F.col("url"), "https://mirror.example/", host="https://").alias("url")
    )


@query("P22", """
WITH h AS (
  SELECT font_id, name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(name, ''), lambda c: unicode(c)::BIGINT)),
                              lambda a, u: (a * 31 + u) & 4294967295) AS h
  FROM (SELECT p_partkey AS font_id, p_brand || ' ' || p_name AS name FROM part))
SELECT font_id, (abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 10)::INT AS bucket FROM h""")
def colour_buckets(spark, sf):
    return fx.font_rows(spark, sf).select(
        "font_id", T.colour_bucket(F.concat("license", F.lit(" "), "name")).alias("bucket")
    )


@query("P24", """
SELECT event_id, floor(least(value / 100, 1) * 100 + 0.5)::INT AS percent, round(least(value / 100, 1), 4) AS score FROM events""")
def displayed_scores(spark, sf):
    score = F.least(F.col("value") / 100, F.lit(1.0))
    return fx.table(spark, sf, "events").select(
        "event_id", T.percent(score).alias("percent"), T.score_text(score).alias("score")
    )


@query("P24", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped
FROM pages""")
def escaped_markup(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))
