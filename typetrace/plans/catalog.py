"""Catalogue, coverage, merge and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from typetrace.functions import scores as S, text as T
from typetrace.operators import catalog as C, report, segment as G, vote
from typetrace.plans import fixtures as fx
from typetrace.plans.registry import query
from typetrace.sources import catalog as SC, history, lines as L

REQUIRED = "abcdefghijklmnopqrstuvwxyzàâçèéêëîïôùûüñáíóúäöß"   # fixed alphabet with accents


@query("S1", """
SELECT p_partkey AS file_pos, 'f' || p_partkey AS id, p_name AS name, p_brand AS license, p_size <= 40 AS commercial_free,
       p_type AS style, p_name || '.ttf' AS file FROM part""")
def catalogue_rows(spark, sf):
    p = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("file_pos"),
        F.to_json(F.struct(
            F.concat(F.lit("f"), "p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("license"), (F.col("p_size") <= 40).alias("commercial_free"),
            F.col("p_type").alias("style"), F.concat("p_name", F.lit(".ttf")).alias("file"),
        )).alias("json"),
    )
    return SC.parse_catalogue(p, "json").select(
        "file_pos", "id", "name", "license", "commercial_free", "style", "file")


@query("S2", """
WITH l AS (SELECT c_custkey AS pos, CASE WHEN c_nationkey = 3 THEN '# ' || c_name WHEN c_nationkey = 4 THEN '  '
                   ELSE ' ' || c_mktsegment || c_nationkey || ': http://host/' || c_name || ': x ' END AS v FROM customer),
e AS (SELECT pos, string_split(trim(v), ': ')[1] AS font_id, substr(trim(v), strpos(trim(v), ': ') + 2) AS url
      FROM l WHERE trim(v) <> '' AND NOT starts_with(trim(v), '#'))
SELECT font_id, arg_max(url, pos) AS url FROM e GROUP BY font_id""")
def manifest_entries(spark, sf):
    value = (
        F.when(F.col("c_nationkey") == 3, F.concat(F.lit("# "), "c_name"))
        .when(F.col("c_nationkey") == 4, F.lit("  "))
        .otherwise(F.concat(F.lit(" "), "c_mktsegment", "c_nationkey", F.lit(": http://host/"), "c_name", F.lit(": x ")))
    )
    return SC.parse_manifest(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), value.alias("value")))


@query("S3", fx.with_views("texts") + """
SELECT text_id, char, max(pos) AS char_pos
FROM (SELECT text_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS char
      FROM (SELECT text_id, string_split(text, '') AS a FROM texts)) WHERE char <> '' GROUP BY text_id, char""")
def character_positions(spark, sf):
    pos = SC.character_positions(fx.text_rows(spark, sf), "text_id")
    return SC.last_positions(pos, "text_id").withColumn("char_pos", F.col("char_pos").cast("bigint"))


@query("S6", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, props AS chars, event_type AS top,
       CASE WHEN s >= 0.9 THEN 'free' WHEN s >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict, s AS score
FROM (SELECT *, least(value / 100, 1) AS s FROM events)""")
def history_lines(spark, sf):
    score = F.least(F.col("value") / 100, F.lit(1.0))
    e = fx.table(spark, sf, "events").select(
        "ts", F.array("props", F.col("event_id").cast("string")).alias("chars"),
        S.verdict(score).alias("verdict"), F.col("event_type").alias("top"), score.alias("score"))
    h = history.history_rows(e)
    return h.select(F.get("chars", F.lit(1)).cast("bigint").alias("event_id"), "ts",
                    F.get("chars", F.lit(0)).alias("chars"), "top", "verdict", "score")


@query("S9 P15", """
WITH f AS (SELECT p_partkey, p_name, p_brand, p_type, p_size,
             CASE p_partkey WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE p_partkey END AS g FROM part)
SELECT arg_min(p_partkey, p_partkey) AS font_id, arg_min(p_name, p_partkey) AS name, arg_min(p_brand, p_partkey) AS license,
       arg_min(p_type, p_partkey) AS style FROM f GROUP BY g""")
def catalogue_listing(spark, sf):
    return C.listing(fx.font_rows(spark, sf), fx.groups(spark, sf))


@query("J3", """
WITH meta AS (SELECT p_partkey AS font_id, p_name AS name, p_brand AS license, 'http://' || p_type AS source_url
              FROM part),
item AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END AS group_id FROM lineitem)
SELECT l_orderkey, l_linenumber, group_id, coalesce(name, group_id::VARCHAR) AS name,
       coalesce(license, '') AS license, coalesce(source_url, '') AS source_url
FROM item LEFT JOIN meta ON font_id = group_id""")
def candidate_metadata(spark, sf):
    """Seventh lines name fonts the catalogue does not have."""
    meta = fx.font_rows(spark, sf).withColumn("source_url", F.concat(F.lit("http://"), "style"))
    font = F.when(F.col("l_linenumber") == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    items = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", font.alias("group_id"))
    return C.with_metadata(items, meta)


@query("J5 A16", f"""
WITH fonts AS (SELECT DISTINCT lang, source, lang = 'en' AND source = 'src0' AS exempt FROM documents),
req AS (SELECT DISTINCT unnest(string_split('{REQUIRED}', '')) AS char),
avail AS (SELECT DISTINCT lang, source, unnest(string_split(lower(text), '')) AS char FROM documents),
hits AS (SELECT lang, source, count(*) AS hits FROM avail JOIN req USING (char) GROUP BY ALL),
r AS (SELECT f.lang, f.source, f.exempt, coalesce(hits, 0) AS hits,
        CASE WHEN exempt THEN 1.0::DOUBLE ELSE coalesce(hits, 0) / (SELECT count(*) FROM req) END AS ratio
      FROM fonts f LEFT JOIN hits h USING (lang, source))
SELECT lang, source, exempt, hits, round(ratio, 6) AS ratio,
       CASE WHEN ratio < 0.5 THEN 'FAIL' WHEN ratio >= 0.9 THEN 'ok' ELSE 'warn' END AS tag FROM r""")
def character_coverage(spark, sf):
    fonts, available = _cover(spark, sf)
    required = C.required_chars(spark, REQUIRED)
    return C.coverage(fonts, available, required, ["lang", "source"]).withColumn("ratio", F.round("ratio", 6))


def _cover(spark, sf):
    docs = fx.table(spark, sf, "documents")
    exempt = (F.col("lang") == "en") & (F.col("source") == "src0")
    fonts = docs.select("lang", "source", exempt.alias("exempt")).distinct()
    chars = F.explode(F.array_distinct(F.split(F.lower("text"), "")))
    return fonts, docs.select("lang", "source", chars.alias("char")).distinct()


@query("U4", f"""
WITH fonts AS (SELECT DISTINCT lang, source FROM documents),
req AS (SELECT DISTINCT unnest(string_split('{REQUIRED}', '')) AS char),
avail AS (SELECT DISTINCT lang, source, unnest(string_split(lower(text), '')) AS char FROM documents)
SELECT lang, source, char FROM fonts, req EXCEPT SELECT lang, source, char FROM avail""")
def missing_characters(spark, sf):
    fonts, available = _cover(spark, sf)
    return C.missing_chars(fonts, available, C.required_chars(spark, REQUIRED), ["lang", "source"])


@query("J6 U3", """
WITH old AS (SELECT p_partkey AS font_id, p_name AS name FROM part WHERE p_size <= 25),
new AS (SELECT DISTINCT l_partkey AS font_id, 'scanned' AS name FROM lineitem)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE font_id NOT IN (SELECT font_id FROM old)""")
def catalogue_merge(spark, sf):
    old = fx.font_rows(spark, sf).filter(F.col("size") <= 25).select("font_id", "name")
    new = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("font_id")).distinct()
    return C.merge_catalogue(old, new.withColumn("name", F.lit("scanned")))


@query("U2", fx.with_views("texts") + """
SELECT DISTINCT unicode(c)::INT AS code FROM (
  SELECT unnest(string_split(text, '')) AS c FROM texts UNION ALL SELECT ' ' UNION ALL SELECT chr(10)) WHERE c <> ''""")
def subset_code_points(spark, sf):
    return C.subset_code_points(fx.text_rows(spark, sf))


@query("P20", """
WITH f AS (SELECT p_partkey AS font_id, p_size > 45 AS sys, CASE WHEN p_size > 45 THEN 'system:' || p_name || '#1' ELSE p_name || '.ttf' END AS file FROM part),
s AS (SELECT DISTINCT p_name || '.ttf' AS file, 'subset/' || p_name || '.ttf' AS sub FROM part WHERE p_type = 'SMALL')
SELECT font_id, CASE WHEN sys THEN f.file ELSE coalesce(sub, 'files/' || f.file) END AS path FROM f LEFT JOIN s USING (file)""")
def resolved_files(spark, sf):
    rows = fx.font_rows(spark, sf)
    is_system = F.col("size") > 45
    fonts = rows.select(
        "font_id", is_system.alias("is_system"),
        F.when(is_system, F.concat(F.lit("system:"), "name", F.lit("#1"))).otherwise(F.concat("name", F.lit(".ttf"))).alias("file"))
    subset = rows.filter(F.col("style") == "SMALL").select(
        F.concat("name", F.lit(".ttf")).alias("file"),
        F.concat(F.lit("subset/"), "name", F.lit(".ttf")).alias("subset_path")).distinct()
    return C.resolve_files(fonts, subset)


@query("W8", """
SELECT replace(lower(trim(p_name)), ' ', '-') AS key, min(p_partkey) AS font_id, arg_min(p_brand, p_partkey) AS license
FROM part GROUP BY 1""")
def first_of_family(spark, sf):
    rows = fx.font_rows(spark, sf).select(T.slug(F.col("name")).alias("key"), "font_id", "license", "file_pos")
    return C.keep_first(rows, ["key"], F.col("file_pos")).drop("file_pos")


@query("W9", fx.with_views("texts") + """
SELECT text_id, char, max(pos) AS seq, arg_max(pos * 7 % 100, pos) AS x1
FROM (SELECT text_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS char
      FROM (SELECT text_id, string_split(text, '') AS a FROM texts)) WHERE char <> '' GROUP BY ALL""")
def latest_mark_per_char(spark, sf):
    marks = SC.character_positions(fx.text_rows(spark, sf), "text_id").select(
        "text_id", "char", F.col("char_pos").cast("bigint").alias("seq"))
    return C.keep_latest(marks.withColumn("x1", F.col("seq") * 7 % 100), ["text_id", "char"], F.col("seq"))


@query("W10", fx.with_views("ocr") + """
SELECT image_id, min(line_no) AS attempt, arg_min(n, line_no) AS n
FROM (SELECT image_id, line_no, CASE WHEN whole_box AND score IS NOT NULL AND text IS NOT NULL
        THEN length(text) % 3 ELSE 0 END AS n FROM ocr) WHERE n > 0 GROUP BY image_id""")
def first_attempt_with_result(spark, sf):
    lines = fx.ocr_lines(spark, sf)
    good = (F.col("box").isNotNull() & F.coalesce(F.forall("box", lambda p: p.isNotNull()), F.lit(False))
            & F.col("text").isNotNull() & F.col("score").isNotNull())
    n = F.when(good, F.length("text") % 3).otherwise(0)
    attempts = lines.select("image_id", F.col("line_no").alias("attempt"), n.cast("bigint").alias("n"))
    return C.first_with_result(attempts, "image_id", "attempt", "n")


@query("W5", fx.with_views("ocr") + """
SELECT image_id, line_no, (x0 + w - x0) * (y0 + h - y0) AS area, row_number() OVER (
  PARTITION BY image_id ORDER BY (x0 + w - x0) * (y0 + h - y0) DESC, line_no) AS rank FROM valid QUALIFY rank <= 3""")
def largest_lines(spark, sf):
    from typetrace.operators.auto import largest_lines as largest
    return largest(L.complete_lines(fx.ocr_lines(spark, sf))).select("image_id", "line_no", "area", "rank")


@query("W15", """
WITH m AS (SELECT p_brand, p_type, p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '-Regular' ELSE p_name || '-Bold' END AS name FROM part)
SELECT p_brand AS archive, p_type AS wanted,
       arg_min(name, CASE WHEN contains(lower(name), 'regular') OR contains(replace(lower(name), '-', ''), 'ring') THEN 0 ELSE 1 END * 1000000000000 + p_partkey) AS name
FROM m GROUP BY ALL""")
def preferred_members(spark, sf):
    rows = fx.font_rows(spark, sf).select(
        F.concat_ws("@", "license", "style").alias("key"), F.col("license").alias("archive"),
        F.col("style").alias("wanted"), "file_pos", F.lit("r-ing").alias("hint"),
        F.concat("name", F.when(F.col("font_id") % 4 == 0, "-Regular").otherwise("-Bold")).alias("name"))
    return C.preferred_member(rows, "key", "name", "file_pos", hint="hint").select("archive", "wanted", "name")


@query("A22", """
SELECT l_shipmode_key AS batch, sum(bi)::DOUBLE AS bytes_in, sum(CASE WHEN st = 'A' THEN bo ELSE 0 END)::DOUBLE AS bytes_out,
       count(*) FILTER (st = 'A') AS n_ok, count(*) FILTER (st = 'N') AS n_skip, count(*) FILTER (st = 'R') AS n_fail,
       round(100 * (1 - sum(CASE WHEN st = 'A' THEN bo ELSE 0 END) / sum(bi)), 4) AS saved_percent
FROM (SELECT l_suppkey AS l_shipmode_key, l_returnflag AS st, floor(l_extendedprice) AS bi,
             floor(l_extendedprice * (1 - l_discount)) AS bo FROM lineitem) GROUP BY 1""")
def size_rollup(spark, sf):
    f = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("batch"),
        F.floor("l_extendedprice").cast("double").alias("bytes_in"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("bytes_out"),
        F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "N", "skip").otherwise("fail").alias("status"))
    return C.size_rollup(f, "batch").withColumn("saved_percent", F.round("saved_percent", 4))


@query("J8", fx.with_views("columns") + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY x0) AS n FROM kept),
chars AS (SELECT line_id, generate_subscripts(u, 1) AS n, unnest(u) AS char
          FROM (SELECT line_id, regexp_extract_all(line, '[\\p{L}\\p{N}]') AS u FROM lines))
SELECT line_id, n - 1 AS seg_no, x0, x1, char FROM numbered JOIN chars USING (line_id, n)""")
def paired_segments(spark, sf):
    segs = G.number_segments(G.drop_narrow(G.long_enough(
        G.column_runs(fx.text_columns(spark, sf), packed=True), fx.text_lines(spark, sf))))
    return G.with_chars(segs, lambda t: T.usable_chars(t["line"]))


@query("J10", """
WITH b AS (SELECT user_id AS image_id, event_id AS seq, event_id * 37 % 900 AS x1, event_id * 53 % 700 AS y1,
             event_id * 37 % 900 + 8 + floor(value)::BIGINT % 90 AS x2, event_id * 53 % 700 + 8 + event_id % 70 AS y2 FROM events),
p AS (SELECT user_id AS image_id, event_id AS point_id, event_id * 91 % 1000 AS px, event_id * 29 % 800 AS py FROM events)
SELECT p.image_id, point_id, px, py, min(seq) AS hit FROM p JOIN b
  ON p.image_id = b.image_id AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 GROUP BY ALL""")
def first_box_hit(spark, sf):
    e, n = fx.table(spark, sf, "events"), F.col("event_id")
    x1, y1 = n * 37 % 900, n * 53 % 700
    boxes = e.select(F.col("user_id").alias("image_id"), n.alias("seq"), x1.alias("x1"), y1.alias("y1"),
                     (x1 + 8 + F.floor("value") % 90).alias("x2"), (y1 + 8 + n % 70).alias("y2"))
    points = e.select(F.col("user_id").alias("image_id"), n.alias("point_id"), (n * 91 % 1000).alias("px"), (n * 29 % 800).alias("py"))
    return report.first_hit(points, boxes)
