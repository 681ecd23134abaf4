"""Votes, floors, verdict classes and empty evidence."""

from pyspark.sql import functions as F

from typetrace.functions import scores as S
from typetrace.operators import auto as A, report, vote
from typetrace.sources import history

TOPS = "request_id bigint, mark_id bigint, char string, font_id bigint, rank int, score double"


def groups(spark):
    return spark.createDataFrame([(0, 0), (1, 0)], "font_id bigint, group_id bigint")


def test_both_members_of_a_group_count(spark):
    tops = spark.createDataFrame([(1, 1, "a", 0, 0, 0.9), (1, 1, "a", 1, 1, 0.9)], TOPS)
    row = vote.rank_weighted_votes(tops, groups(spark)).collect()[0]
    assert (row.group_id, row.votes) == (0, 2) and abs(row.score - 0.9 * (1 + 0.85) / 2) < 1e-12
    one = vote.rank_weighted_votes(tops, groups(spark), one_vote_per_group=True).collect()[0]
    assert (one.votes, one.score) == (1, 0.9)


def test_absence_is_not_punished(spark):
    tops = spark.createDataFrame([(1, 1, "a", 5, 0, 0.8), (1, 2, "b", 6, 0, 0.7), (1, 3, "c", 6, 0, 0.7)], TOPS)
    cands = vote.rank_candidates(vote.rank_weighted_votes(tops, groups(spark)))
    assert [(r.group_id, r.votes) for r in cands.orderBy("rank").collect()] == [(5, 1), (6, 2)]
    by_votes = vote.rank_candidates(
        vote.rank_weighted_votes(tops, groups(spark)), min_score=None, by_votes=True)
    assert by_votes.orderBy("rank").first().group_id == 6


def test_boundaries(spark):
    scores = [0.9, 0.8999999, 0.75, 0.7499999, 0.55, 0.0, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    got = [r.v for r in df.orderBy("i").select(S.verdict(F.col("s")).alias("v")).collect()]
    assert got == ["free", "suspect", "suspect", "risky", "risky", "risky", "unknown"]
    voted = spark.createDataFrame([(1, 1, 0.55, 1), (2, 1, 0.5499999, 1)], "request_id int, group_id int, score double, votes int")
    assert [r.request_id for r in vote.rank_candidates(voted).collect()] == [1]


def test_no_evidence_is_unknown_and_keeps_its_row(spark):
    marks = spark.createDataFrame([(1, 1, "a"), (2, 2, "?")], "request_id bigint, mark_id bigint, char string")
    tops = spark.createDataFrame([(1, 1, "a", 0, 0, 0.95)], TOPS)
    cands = vote.rank_candidates(vote.rank_weighted_votes(tops, groups(spark)))
    rows = {r.request_id: r for r in vote.request_verdicts(marks, cands).collect()}
    assert rows[1].verdict == "free" and (rows[2].verdict, rows[2].confidence) == ("unknown", 0.0)
    meta = spark.createDataFrame([(0, "Zero", "OFL", "u")], "font_id bigint, name string, license string, source_url string")
    ev = {r.mark_id: r.top for r in report.evidence(marks, tops, groups(spark), meta).collect()}
    assert ev[2] == [] and ev[1][0].name == "Zero"


def test_one_wrong_label_fails_the_line(spark):
    marks = spark.createDataFrame([("l", "1", "a"), ("l", "2", "b"), ("k", "3", "a")], "line_id string, mark_id string, char string")
    found = spark.createDataFrame(
        [("1", "a", 0.9, 0), ("2", "c", 0.9, 0), ("2", "b", 0.8, 1), ("3", "a", 0.6, 0)],
        "mark_id string, char string, score double, rank int")
    assert {r.line_id: r.agree for r in A.labels_agree(marks, found).collect()} == {"l": False, "k": True}


def test_limits_of_verdicts(spark):
    cands = spark.createDataFrame([(1, 5, 0.8, 2, 1), (2, 5, 0.6, 1, 1)], "request_id bigint, group_id bigint, score double, votes int, rank int")
    marks = spark.createDataFrame([(1,), (2,), (3,)], "request_id bigint")
    by = lambda **limits: {r.request_id: r.verdict for r in vote.request_verdicts(marks, cands, **limits).collect()}
    assert by() == {1: "suspect", 2: "risky", 3: "unknown"}
    assert by(free_from=0.8, suspect_from=0.5) == {1: "free", 2: "suspect", 3: "unknown"}


def test_long_requests_are_reported_in_pages(spark):
    """Seven marks on pages of three; a request without marks has one page without evidence."""
    report_rows = spark.createDataFrame([(1, "free"), (2, "unknown")], "request_id bigint, verdict string")
    tops = "array<struct<rank:int,font_id:bigint,name:string,score:double>>"
    evidence = spark.range(7).selectExpr("1L AS request_id", "6 - id AS mark_id", "chr(CAST(103 - id AS int)) AS char", f"CAST(array() AS {tops}) AS top")
    got = report.paged_report(report_rows, evidence, page=3).collect()
    pages = {(r.request_id, r.page): "".join(m.char for m in r.per_char) for r in got}
    assert pages == {(1, 0): "abc", (1, 1): "def", (1, 2): "g", (2, 0): ""}
    assert {r.verdict for r in got if r.request_id == 1} == {"free"}


def test_history_keeps_the_order_of_marks(spark):
    marks = spark.createDataFrame([(1, 3, "a"), (1, 1, "z"), (1, 2, "a"), (2, 4, "b")], "request_id bigint, mark_id bigint, char string")
    full = spark.sql("SELECT * FROM VALUES (1L, 'free', 0.95D, array(named_struct('name', 'N1'))), (2L, 'unknown', 0.0D, NULL) AS t(request_id, verdict, confidence, candidates)")
    got = {r.request_id: (r.chars, r.top, r.score) for r in history.request_rows(marks, full.withColumn("ts", F.timestamp_seconds(F.lit(0)))).collect()}
    assert got == {1: (["z", "a", "a"], "N1", 0.95), 2: (["b"], "", 0.0)}
