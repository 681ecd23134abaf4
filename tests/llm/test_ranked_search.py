import random
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from test_decontamination import words
from typetrace.llm import ranked_search as rs
from typetrace.llm import tokens


def plain(docs, items, top=20):
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        asked, found = Counter(words(text)), []
        for doc, b in bags:
            m = 100 - 25 + (25 * b.total() * n_docs) // n_terms
            score = sum(c * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in asked.items() if b[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, n, doc, -s) for n, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    text = lambda n: " ".join(f"t{int(rnd.paretovariate(0.5)) % 900}" for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 300))) for i in range(700)]
    rnd.shuffle(docs)
    docs += [(i, "same text here t1 t2 t3") for i in range(1000, 1060)] + [(9, docs[0][1]), (9, docs[0][1]), (None, "Solo É t5"), (2000, None), (2001, ""), (2002, "!?"), (2003, "big " * 100_000 + "t7")]
    items = [(i, text(rnd.choice([1, 3, 20, 60]))) for i in range(25)] + [(30, "same text"), (30, "same text"), (30, "other t9"), (31, None), (32, ""), (33, "--"), (34, "nowhere found"), (None, "Solo é É"), (35, "t1 t1 T1"), (36, "big t7")]
    return docs, items


def test_ranks_match_all_scores(spark, docs_of, case):
    docs, items = case
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS k", "'y' AS rank", "'z' AS doc_id")
    assert got(rs.rank_documents(docs_of(docs), table)) == plain(docs, items)


def test_parts_of_items_and_whole_index(spark, docs_of, case, monkeypatch):
    docs, items = case
    table = spark.createDataFrame(items, "item_id long, text string")
    real = tokens.item_parts
    monkeypatch.setattr(rs, "item_parts", lambda *a: real(*a, limit=2000))
    assert got(rs.rank_documents(docs_of(docs), table, top=5)) == plain(docs, items, 5)
    index = rs.build_index(docs_of(docs).repartition(3))
    bags = [Counter(words(t)) for _, t in docs]
    df = Counter(t for b in bags for t in b)
    assert {r.term: r.df for r in index.frequencies().collect()} == df
    assert (index.n_docs, index.n_terms) == (sum(map(bool, bags)), sum(b.total() for b in bags))


@pytest.mark.parametrize("shape", [(1, 1), (3, 40), (200, 9), (64, 64), (50, 1000)])
def test_treap_search_matches_sums(shape, monkeypatch):
    monkeypatch.setattr(rs, "OPENED", 3)
    rnd = np.random.default_rng(shape[1])
    grid = np.where(rnd.random(shape) < 0.2, rnd.integers(0, 40, shape), 0)
    grid[0, 0] = 7
    row, column = np.nonzero(grid)
    treap = rs.Treap.load(*rs.Treap.pack(*shape, row, column, grid[row, column]))
    for _ in range(20):
        rows = np.unique(rnd.integers(0, shape[0], 8))
        rows = rows[grid[rows].any(axis=1)]
        weights = rnd.integers(1, 5, len(rows))
        score = (grid[rows] * weights[:, None]).sum(axis=0)
        want = sorted((-s, c) for c, s in enumerate(score.tolist()) if s >= 10)[:6]
        if len(rows):
            assert treap.search(rows, weights, 10, 6) == [(-s, c) for s, c in want]


def test_cells_hold_maxima():
    grid = np.array([[0, 5, 0, 0], [9, 0, 0, 2], [0, 0, 0, 0], [0, 0, 1, 0]])
    row, column = np.nonzero(grid)
    treap = rs.Treap.load(*rs.Treap.pack(4, 4, row, column, grid[row, column]))
    assert [m.tolist() for m in treap.most] == [[9], [9, 2, 1], [5, 9, 2, 1]] and treap.quarters[0].tolist() == [0b1011]


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rs.rank_documents(docs_of([(1, "a")]).filter("false"), items).collect() == []
    assert rs.rank_documents(docs_of([(1, "a"), (2, None)]), items.filter("false")).collect() == []
    assert rs.rank_documents(docs_of([(1, None)]), items).collect() == []
