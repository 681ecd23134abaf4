"""Search, fusion, vote and verdict over templates and crops derived from the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from typetrace.functions import scores as S
from typetrace.operators import evaluate, report, search, vote
from typetrace.plans import fixtures as fx
from typetrace.plans.registry import query
from typetrace.session import cut_lineage
from typetrace.sources import history

_SEARCH = fx.with_views("glyphs", "features", "search")
_VOTE = fx.with_views("glyphs", "features", "search", "vote")


def _tops(spark, sf, crops=None):
    crops = fx.crops(spark, sf) if crops is None else crops
    return search.match_marks(crops, fx.templates(spark, sf), fx.WORDS, fx.SIDE)


def _candidates(spark, sf, crops=None):
    return vote.rank_candidates(vote.rank_weighted_votes(_tops(spark, sf, crops), fx.groups(spark, sf)))


@query("C10 P9 P10", _VOTE + """
SELECT r.request_id,
       CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'free'
            WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict,
       coalesce(round(score, 4), 0.0) AS confidence, group_id AS best_font, coalesce(votes, 0) AS votes
FROM (SELECT DISTINCT request_id FROM crop) r
LEFT JOIN cands c ON c.request_id = r.request_id AND c.rank = 1""")
def match_requests(spark, sf):
    crops = fx.crops(spark, sf)
    return vote.request_verdicts(crops, _candidates(spark, sf, crops))


@query("C9 J1 W1 W2 A11 A12 A13", _SEARCH + """
SELECT request_id, mark_id, char, font_id, rank, round(iou, 6) AS iou, round(ncc, 6) AS ncc,
       round(cosine, 6) AS cosine, round(score, 6) AS score FROM tops""")
def match_marks(spark, sf):
    return _tops(spark, sf).select(
        "request_id", "mark_id", "char", "font_id", "rank",
        *[F.round(c, 6).alias(c) for c in ("iou", "ncc", "cosine", "score")],
    )


@query("C9 J1 W1 W2 A9 A13", _SEARCH + """
SELECT mark_id, font_id, rank, coarse_rank, round(iou, 6) AS iou, round(score, 6) AS score FROM tops""")
def match_marks_joined(spark, sf):
    return search.match_marks_joined(fx.crops(spark, sf), fx.templates(spark, sf), fx.WORDS).select(
        "mark_id", "font_id", "rank", "coarse_rank",
        F.round("iou", 6).alias("iou"), F.round("score", 6).alias("score"),
    )


@query("A1 W3 P10 W13", _VOTE + """
SELECT request_id, group_id, rank, votes, round(score, 6) AS score FROM cands""")
def request_candidates(spark, sf):
    return _candidates(spark, sf).select(
        "request_id", "group_id", "rank", "votes", F.round("score", 6).alias("score"))


@query("A1", _VOTE + """
, one AS (SELECT request_id, mark_id, coalesce(group_id, t.font_id) AS group_id, max(score * (1 - 0.15 * rank)) AS w
  FROM tops t LEFT JOIN same s ON s.font_id = t.font_id GROUP BY ALL)
SELECT request_id, group_id, round(avg(w), 6) AS score, count(*) AS votes FROM one GROUP BY ALL""")
def single_group_votes(spark, sf):
    voted = vote.rank_weighted_votes(_tops(spark, sf), fx.groups(spark, sf), one_vote_per_group=True)
    return voted.withColumn("score", F.round("score", 6))


_SEEN = _SEARCH + """, same(font_id, group_id) AS (VALUES (0, 0), (1, 0), (2, 2), (3, 2)),
seen AS (SELECT request_id, coalesce(group_id, t.font_id) AS group_id, score, char, mark_id AS ord
         FROM tops t LEFT JOIN same s ON s.font_id = t.font_id WHERE rank = 0 AND score >= 0.6),
counted AS (SELECT request_id, group_id, avg(score) AS score, count(*) AS votes, arg_min(char, ord) AS char_matched
            FROM seen GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY votes DESC, score DESC, group_id) AS rank FROM counted)
"""


def _seen(spark, sf):
    """Best fonts of single marks as two partial vote tables, put together before averaging."""
    best = _tops(spark, sf).filter((F.col("rank") == 0) & (F.col("score") >= S.MIN_AUTO))
    seen = vote.with_group(best, fx.groups(spark, sf)).select(
        "request_id", "group_id", "score", "char", F.col("mark_id").alias("ord"))
    odd = F.col("char").isin("b", "d")
    return vote.merge_votes(seen.filter(odd), seen.filter(~odd))


@query("A2 A3 U1 P10", _SEEN + """
SELECT request_id, group_id, rank, votes, char_matched, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def counted_votes(spark, sf):
    ranked = vote.rank_candidates(vote.counted_votes(_seen(spark, sf)), min_score=None, by_votes=True)
    return ranked.select("request_id", "group_id", "rank", "votes", "char_matched", F.round("score", 6).alias("score"))


@query("A2 P9", _SEEN + """
SELECT r.request_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'free' WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict,
       round(score, 8) AS confidence, group_id AS best_font
FROM (SELECT DISTINCT request_id FROM crop) r LEFT JOIN ranked k ON k.request_id = r.request_id AND k.rank = 1""")
def counted_verdicts(spark, sf):
    ranked = vote.rank_candidates(vote.counted_votes(_seen(spark, sf)), min_score=None, top_k=1, by_votes=True)
    requests = fx.crops(spark, sf).select("request_id").distinct()   # no evidence is an answer too
    return requests.join(ranked, "request_id", "left").select(
        "request_id", S.verdict(F.col("score")).alias("verdict"),
        F.round("score", 8).alias("confidence"), F.col("group_id").alias("best_font"))


@query("A9", """
WITH w AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0
             THEN 1::HUGEINT << (63 - i)::INT ELSE 0::HUGEINT END)) AS w FROM embeddings)
SELECT a.vec_id, b.vec_id AS other_id, round(bit_count(a.w & b.w) / bit_count(a.w | b.w), 6) AS iou
FROM w a JOIN w b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)""")
def bitmap_overlap(spark, sf):
    return _partner_score(spark, sf, lambda a, b: S.iou(a, b, fx.WORDS))


@query("A10", """
WITH w AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS other_id,
        list_sum(list_transform(range(0, 64), lambda i: a.b[i + 1] * b.b[i + 1] * (128 >> (i % 8)::INT))) AS inter,
        list_sum(list_transform(range(0, 64), lambda i: greatest(a.b[i + 1], b.b[i + 1]) * (128 >> (i % 8)::INT))) AS uni
      FROM w a JOIN w b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))
SELECT vec_id, other_id, round(inter / uni, 6) AS iou FROM p""")
def byte_weighted_overlap(spark, sf):
    return _partner_score(spark, sf, lambda a, b: S.byte_weighted_overlap(a, b, fx.WORDS))


def _partner_score(spark, sf, score):
    rows = search.with_features(fx.glyphs(spark, sf), "field", fx.WORDS).select("vec_id", "words")
    n = F.broadcast(rows.agg(F.count("*").alias("n")))   # one row
    other = rows.select(F.col("vec_id").alias("other_id"), F.col("words").alias("other"))
    return rows.crossJoin(n).withColumn("other_id", (F.col("vec_id") * 7 + 3) % F.col("n")).join(other, "other_id").select(
        "vec_id", "other_id", F.round(score(F.col("words"), F.col("other")), 6).alias("iou"))


@query("G10", """
SELECT vec_id, (CASE WHEN w >= 9223372036854775808::HUGEINT THEN w - 18446744073709551616::HUGEINT ELSE w END)::BIGINT AS word,
       bit_count(w)::INT AS pop
FROM (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0
        THEN 1::HUGEINT << (63 - i)::INT ELSE 0::HUGEINT END)) AS w FROM embeddings)""")
def packed_bitmaps(spark, sf):
    rows = search.with_features(fx.glyphs(spark, sf), "field", fx.WORDS)
    return rows.select("vec_id", F.get("words", F.lit(0)).alias("word"), "pop")


@query("C14", fx.with_views("glyphs", "features", "search") + """
SELECT mark_id, font_id, row_number() OVER (PARTITION BY mark_id ORDER BY iou DESC, font_id) - 1 AS rank, round(iou, 6) AS score
FROM coarse QUALIFY rank < 5""")
def match_marks_coarse_only(spark, sf):
    """The bounded form; the join form gives the same rows (tests/test_search.py)."""
    rows = search.match_marks(fx.crops(spark, sf), fx.templates(spark, sf), fx.WORDS, fx.SIDE, use_fields=False)
    return rows.select("mark_id", "font_id", "rank", F.round("score", 6).alias("score"))


@query("J4", fx.with_views("glyphs", "features", "search") + """
SELECT c.request_id, c.mark_id, c.char, count(t.font_id) AS n_top, min(CASE WHEN t.rank = 0 THEN coalesce(s.g, t.font_id) END) AS first_font
FROM crop c LEFT JOIN tops t ON t.mark_id = c.mark_id AND c.char <> 'c'
LEFT JOIN (VALUES (0, 0), (1, 0), (2, 2), (3, 2)) s(f, g) ON s.f = t.font_id GROUP BY ALL""")
def evidence_per_mark(spark, sf):
    """The index lacks one character, so its marks keep an empty list."""
    crops = fx.crops(spark, sf)
    tops = search.match_marks(crops, fx.templates(spark, sf).filter(F.col("char") != "c"), fx.WORDS, fx.SIDE)
    rows = report.evidence(crops, tops, fx.groups(spark, sf), _meta(spark, sf))
    return rows.select("request_id", "mark_id", "char", F.size("top").cast("bigint").alias("n_top"),
                       F.get("top", F.lit(0))["font_id"].alias("first_font"))


def _meta(spark, sf):
    return fx.font_rows(spark, sf).withColumn("source_url", F.concat(F.lit("http://"), "style"))


@query("C13 J3", _VOTE + """, cand_text AS (
  SELECT request_id, string_agg(group_id || ':' || p_name || ':' || p_brand || ':' || votes, ',' ORDER BY rank) AS candidates
  FROM cands JOIN part ON p_partkey = group_id GROUP BY request_id)
SELECT r.request_id, coalesce(candidates, '') AS candidates, coalesce(best.verdict, 'unknown') AS verdict
FROM (SELECT DISTINCT request_id FROM crop) r LEFT JOIN cand_text USING (request_id)
LEFT JOIN (SELECT request_id, CASE WHEN score >= 0.9 THEN 'free' WHEN score >= 0.75 THEN 'suspect' ELSE 'risky' END AS verdict
           FROM cands WHERE rank = 1) best USING (request_id)""")
def request_reports(spark, sf):
    crops, meta = fx.crops(spark, sf), _meta(spark, sf)
    cands = _candidates(spark, sf, crops)
    full = report.request_report(vote.request_verdicts(crops, cands), cands, meta)
    cand = F.transform("candidates", lambda c: F.concat_ws(":", c["font_id"], c["name"], c["license"], c["votes"]))
    return full.select("request_id", "verdict", F.coalesce(F.array_join(cand, ","), F.lit("")).alias("candidates"))


@query("C13 J4", _VOTE + """, cand_text AS (
  SELECT request_id, string_agg(group_id || ':' || p_name, ',' ORDER BY rank) AS candidates
  FROM cands JOIN part ON p_partkey = group_id GROUP BY request_id),
lists AS (
  SELECT c.request_id, c.mark_id, c.char || ':' || coalesce(string_agg(coalesce(s.g, t.font_id), '+' ORDER BY t.rank), '') AS item
  FROM crop c LEFT JOIN tops t ON t.mark_id = c.mark_id
  LEFT JOIN (VALUES (0, 0), (1, 0), (2, 2), (3, 2)) s(f, g) ON s.f = t.font_id GROUP BY c.request_id, c.mark_id, c.char)
SELECT request_id, mark_id // 50 AS page, coalesce(candidates, '') AS candidates, string_agg(item, ',' ORDER BY mark_id) AS per_char
FROM lists LEFT JOIN cand_text USING (request_id) GROUP BY ALL""")
def paged_reports(spark, sf):
    """Reports with the evidence of their marks, fifty places to a page."""
    crops, groups, meta = fx.crops(spark, sf), fx.groups(spark, sf), _meta(spark, sf)
    tops = cut_lineage(_tops(spark, sf, crops), "tops")   # read by the votes and by the marks
    cands = vote.rank_candidates(vote.rank_weighted_votes(tops, groups))
    full = report.request_report(vote.request_verdicts(crops, cands), cands, meta)
    paged = report.paged_report(full, report.evidence(crops, tops, groups, meta), page=50)
    cand = F.transform("candidates", lambda c: F.concat_ws(":", c["font_id"], c["name"]))
    mark = F.transform("per_char", lambda m: F.concat(m["char"], F.lit(":"), F.array_join(m["top"]["font_id"].cast("array<string>"), "+")))
    return paged.select("request_id", "page", F.coalesce(F.array_join(cand, ","), F.lit("")).alias("candidates"), F.array_join(mark, ",").alias("per_char"))


@query("S6", _VOTE + """
SELECT r.request_id, chars, coalesce(p_name, '') AS top, coalesce(round(score, 4), 0.0) AS score
FROM (SELECT request_id, string_agg(char, '' ORDER BY mark_id) AS chars FROM crop GROUP BY request_id) r
LEFT JOIN cands c ON c.request_id = r.request_id AND c.rank = 1 LEFT JOIN part ON p_partkey = group_id""")
def request_history(spark, sf):
    crops = fx.crops(spark, sf)
    cands = _candidates(spark, sf, crops)
    full = report.request_report(vote.request_verdicts(crops, cands), cands, _meta(spark, sf))
    rows = history.request_rows(crops, full.withColumn("ts", F.timestamp_seconds("request_id")))
    return rows.select("request_id", F.array_join("chars", "").alias("chars"), "top", "score")


@query("W11", _SEARCH + """
SELECT mark_id, font_id, rank, round(greatest(score, 0) / CASE WHEN t = 0 THEN 1 ELSE t END * 100, 4) AS share
FROM (SELECT *, sum(greatest(score, 0)) OVER (PARTITION BY mark_id) AS t FROM tops WHERE rank < 3)""")
def evidence_shares(spark, sf):
    return report.shares(_tops(spark, sf)).select("mark_id", "font_id", "rank", F.round("share", 4).alias("share"))


@query("W12", _VOTE + """
SELECT t.request_id, t.mark_id, t.char, coalesce(s.group_id, t.font_id) AS group_id, c.group_id AS winner
FROM tops t LEFT JOIN same s ON s.font_id = t.font_id JOIN cands c ON c.request_id = t.request_id AND c.rank = 1
WHERE t.rank = 0 AND coalesce(s.group_id, t.font_id) <> c.group_id""")
def disagreeing_marks(spark, sf):
    crops, groups = fx.crops(spark, sf), fx.groups(spark, sf)
    tops = cut_lineage(_tops(spark, sf, crops), "tops")   # read by the votes and by the marks
    cands = vote.rank_candidates(vote.rank_weighted_votes(tops, groups))
    return report.disagreements(crops, tops, cands, groups).select(
        "request_id", "mark_id", "char", "group_id", "winner")


@query("A17", _SEARCH + """
SELECT request_id, string_agg(font_id, ',' ORDER BY o) AS legend
FROM (SELECT request_id, font_id, min(mark_id * 5 + rank) AS o FROM tops GROUP BY ALL) GROUP BY request_id""")
def chart_legends(spark, sf):
    tops = _tops(spark, sf).withColumn("ord", F.col("mark_id") * 5 + F.col("rank"))
    legend = report.first_seen(tops, "request_id", "font_id", "ord")
    return legend.select("request_id", F.array_join(F.col("values").cast("array<string>"), ",").alias("legend"))


_HITS = _VOTE + """, truth AS (SELECT DISTINCT request_id, true_font, mode FROM crop),
hits AS (
  SELECT t.request_id, true_font, mode, max((c.rank = 1 AND c.group_id = coalesce(s.group_id, true_font))::INT) AS a,
         max((c.group_id = coalesce(s.group_id, true_font))::INT) AS b, max(CASE WHEN c.rank = 1 THEN c.group_id END) AS predicted
  FROM truth t LEFT JOIN same s ON s.font_id = true_font LEFT JOIN cands c ON c.request_id = t.request_id GROUP BY ALL),
hit AS (SELECT request_id, true_font, mode, coalesce(a, 0) AS top1, coalesce(b, 0) AS top5, predicted FROM hits)
"""


def _hits(spark, sf):
    crops = fx.crops(spark, sf)
    truth = crops.select("request_id", "true_font", "mode").distinct()
    return evaluate.request_hits(truth, _candidates(spark, sf, crops), fx.groups(spark, sf))


@query("A14", _HITS + """
SELECT mode, true_font, count(*) AS n, sum(top1)::BIGINT AS top1, sum(top5)::BIGINT AS top5,
       round(avg(top1), 6) AS top1_rate, round(avg(top5), 6) AS top5_rate
FROM hit GROUP BY GROUPING SETS ((), (mode), (true_font))""")
def accuracy(spark, sf):
    return evaluate.accuracy(_hits(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("top1_rate", "top5_rate")})


@query("A15", _HITS + """
SELECT true_font, coalesce(predicted::VARCHAR, 'none') AS predicted, count(*) AS n FROM hit WHERE top5 = 0 GROUP BY ALL""")
def confusion_counts(spark, sf):
    return evaluate.confusions(_hits(spark, sf))


@query("W14", _HITS + """
SELECT true_font, round(avg(top1), 6) AS rate, count(*) AS n FROM hit GROUP BY true_font ORDER BY avg(top1), true_font LIMIT 6""")
def weakest_fonts(spark, sf):
    return evaluate.weakest_fonts(_hits(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("W14", _HITS + """
SELECT true_font, coalesce(predicted::VARCHAR, 'none') AS predicted, count(*) AS n FROM hit WHERE top5 = 0
GROUP BY ALL ORDER BY n DESC, true_font, predicted LIMIT 8""")
def main_confusions(spark, sf):
    return evaluate.main_confusions(_hits(spark, sf))


_GRID = fx.with_views("glyphs", "features") + """, pairs AS (
  SELECT c.mark_id, t.font_id, t.char, c.cf AS qc, t.cf AS tc, c.field AS qf, t.field AS tf,
         CASE WHEN bit_count(c.w | t.w) > 0 THEN bit_count(c.w & t.w) / bit_count(c.w | t.w) ELSE 0.0 END AS iou
  FROM crop_f c, tpl_f t),
coarse AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY mark_id ORDER BY iou DESC, font_id, char) <= 10),
scored AS (
  SELECT mark_id, font_id, char, iou,
    0.65 * least(greatest(list_dot_product(qc, tc) / sqrt(list_dot_product(qc, qc) * list_dot_product(tc, tc)), 0.0), 1.0)
    + 0.35 * least(greatest(list_dot_product(qf, tf) / sqrt(list_dot_product(qf, qf) * list_dot_product(tf, tf)), 0.0), 1.0) AS score
  FROM coarse)
SELECT mark_id, font_id, char, round(iou, 6) AS iou, round(score, 6) AS score,
       row_number() OVER (PARTITION BY mark_id ORDER BY score DESC, font_id, char) - 1 AS rank FROM scored"""


def _grid(spark, sf, **how):
    # Features are stored once; the search reads both tables more than once.
    crops, index = search.cut_lineage(fx.crops(spark, sf)), search.cut_lineage(fx.templates(spark, sf))
    found = search.search_grid(crops, index, fx.WORDS, fx.SIDE, **how)
    return found.select("mark_id", "font_id", "char", F.round("iou", 6).alias("iou"), F.round("score", 6).alias("score"), "rank")


@query("J2 W4", _GRID)
def grid_search(spark, sf):
    """Small bands, so that the pruning between bands has work to do."""
    return _grid(spark, sf, templates_per_task=200)


@query("J2 W4", _GRID)
def grid_search_unpruned(spark, sf):
    return _grid(spark, sf, prune=False)
