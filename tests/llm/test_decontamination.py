import hashlib
import random
import re

import numpy as np
import pytest

from typetrace.llm import decontamination as dc
from typetrace.llm import tokens


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[s:s + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for m in {len(p) for p in windows}:
            for s in range(len(w) - m + 1):
                if found := windows.get(tuple(w[s:s + m])):
                    hit.update(range(s, s + m))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "of", "Über", "x1", "ça"]) if rnd.random() < 0.5 else f"v{rnd.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 7, 9, 10, 11, 25, 60])))) for i in range(40) for _ in (0,)]
    items = [(i, t if len(words(t)) > 1 else f"lone{i}") for i, t in items]
    items += [(3, items[20][1]), (3, items[3][1]), (None, "a passage without a name that is longer than ten words " * 2), (77, None), (78, ""), (79, " ?!"), (80, items[30][1])]
    items += [(90, "go " * 30), (91, "go " * 4)]
    docs = []
    for i in range(150):
        text = [word() for _ in range(rnd.randrange(200))]
        for _ in range(rnd.randrange(3)):
            w = words(rnd.choice(items)[1])
            s = rnd.randrange(max(1, len(w) - 4))
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w[s:s + rnd.choice([9, 10, 11, 30])]
        docs.append((i, rnd.choice([" ", ", ", " - ", "\n"]).join(t.upper() if rnd.random() < 0.2 and t.isascii() else t for t in text)))
    docs += [(200, None), (201, ""), (202, "..."), (203, "go " * 200_000), (None, items[2][1]), (5, docs[5][1]), (5, docs[5][1]), (204, "of the " * 30)]
    # An item's words over the end of one text and the start of the next are no occurrence.
    w = words("a passage without a name that is longer than ten words")
    return docs + [(205, " ".join(w[:5])), (206, " ".join(w[5:]))], items


def test_hits_match_plain_windows(spark, docs_of, case):
    docs, items = case
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS items", "'y' AS part", "'z' AS doc_id")
    assert got(dc.contamination(docs_of(docs), table)) == plain(docs, items)


def test_items_in_parts(spark, docs_of, case, monkeypatch):
    """With few bytes of items at a time the rows are searched part after part."""
    docs, items = case
    table = spark.createDataFrame(items, "item_id long, text string")
    parts = list(tokens.item_parts(table, limit=700))
    assert len(parts) > 1 and sum(p.num_rows for p in parts) == len({i for i in items if i[1] is not None})
    monkeypatch.setattr(dc, "item_parts", lambda *a: iter(parts[:3]))
    some = [tuple(r.values()) for p in parts[:3] for r in p.to_pylist()]
    assert got(dc.contamination(docs_of(docs), table)) == plain(docs, some)


def test_one_giant_item_is_a_part(spark):
    table = spark.createDataFrame([(1, "a " * 5000), (2, "b"), (2, "b")], "item_id long, text string")
    assert sorted(p.num_rows for p in tokens.item_parts(table, limit=100) if p.num_rows) == [1, 1]


@pytest.mark.parametrize("m", [1, 2, 3, 10])
def test_shifts_pass_over_no_occurrence(m):
    rnd = np.random.default_rng(m)
    patterns = np.unique(rnd.integers(1, 4, (60, m)), axis=0)
    text = rnd.integers(0, 4, 20_000)
    tables, order = dc.Shifts.of(patterns)
    at, which = tables.find(text)
    want = {(s, tuple(text[s:s + m])) for s in range(len(text) - m + 1)} & {(s, tuple(p)) for p in patterns for s in np.flatnonzero((np.lib.stride_tricks.sliding_window_view(text, m) == p).all(axis=1))}
    assert {(s, tuple(tables.patterns[p])) for s, p in zip(at.tolist(), which.tolist())} == want and len(at) == len(want)


def test_blocks_of_no_pattern_are_skipped():
    tables, _ = dc.Shifts.of(np.arange(1, 11)[None, :])
    assert tables.shift.max() == 9 and (tables.shift == 9).mean() > 0.99 and (tables.shift == 0).sum() == 1


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert got(dc.contamination(docs_of([(1, "A b"), (2, None)]), none)) == [(1, 2, 0, 0, empty, False), (2, 0, 0, 0, empty, False)]
    assert dc.contamination(docs_of([(1, "a")]).filter("false"), none).collect() == []
