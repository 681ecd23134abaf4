import hashlib

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from typetrace.llm import exact_dedup as ed


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


LONG = "Some words here. " * 900
ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, LONG), (7, LONG + "x"), (8, LONG), (9, "x" + LONG), (10, "é\n" * 5000),
        (11, "é\n" * 5000), (2, "a"), (12, " a"), (None, "b"), (13, "b"), (None, "c"), (None, "c")]


def test_groups_of_equal_texts(docs_of):
    assert got(ed.exact_dedup(docs_of(ROWS))) == plain(ROWS)


def test_shared_hashes_are_told_apart(docs_of):
    few = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    assert got(ed.exact_dedup(docs_of(ROWS), chunk_hash=few)) == plain(ROWS)


def test_empty_table(docs_of):
    assert got(ed.exact_dedup(docs_of(ROWS).filter("false"))) == []


def test_rows_that_stay_keep_their_columns(docs_of):
    docs = docs_of(ROWS[:12])
    out = ed.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 2, 3, 5, 7, 8, 9, 11]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab.\n é😀", max_size=3000), min_size=1, max_size=8))
def test_chunks_join_to_the_text_and_are_bounded(spark, texts):
    for text, chunks in spark.createDataFrame([(t,) for t in texts], "t string").select("t", ed.chunks_of(F.col("t"), 8, 32)).collect():
        assert "".join(chunks) == text and all(len(c) <= 33 for c in chunks)


def test_cuts_meet_again_after_an_insertion(spark):
    text = "".join(f"Sentence number {i} of the text. " for i in range(400))
    one, two = (r[0] for r in spark.createDataFrame([(text,), ("Inserted. " + text,)], "t string").select(ed.chunks_of(F.col("t"), 64, 512)).collect())
    assert len(set(one) & set(two)) > 0.5 * len(one)
