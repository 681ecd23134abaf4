import random
import re
from math import comb

import numpy as np
import pytest

from typetrace.llm import minhash
from typetrace.llm.graph import components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def plain(rows, width, similar=80):
    """Components by comparing all pairs; rows that share an id are one."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= similar * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({(i, len(s), find(i), find(i) == i) for i, s in sets})


def got(df):
    return sorted({tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()})


def family(rnd, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(6)
    texts = [" ".join(f"v{rnd.randrange(5000)}" for _ in range(rnd.randrange(1, 120))) for _ in range(150)]
    for size, edits in ((40, 3), (30, 10), (25, 1), (2, 2), (60, 5)):
        texts += family(rnd, [f"b{rnd.randrange(10**6)}" for _ in range(150)], size, edits)
    shared = " ".join(f"p{i}" for i in range(40))
    texts += [f"{shared} t{i} u{i} x{i}" for i in range(60)] + [f"{shared} " + " ".join(f"r{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    texts += [None, "", " \n", "one", "One", "one two three", "ONE TWO THREE", "É x y z q", "é x y z q", "a b " * 50_000]
    texts += texts[:40]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_all_pairs(docs_of, corpus, width):
    assert got(minhash.near_duplicates(docs_of(corpus), width)) == plain(corpus, width)


def test_large_families_are_compared_in_blocks(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 8)
    assert got(minhash.near_duplicates(docs_of(corpus), 4)) == plain(corpus, 4)
    monkeypatch.setattr(minhash, "MEMBER_SHINGLES", 1000)
    assert got(minhash.near_duplicates(docs_of(corpus), 4)) == plain(corpus, 4)


def test_a_family_below_the_threshold(spark, docs_of):
    """Two thousand variants of one text at 0.70 to 0.80, a few of them linked: the links and no more come out of the blocks."""
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(2000):
        words = list(base)
        for at in rnd.sample(range(30), 3):  # three of 30 places, four words apart
            words[4 * at] = f"w{rnd.randrange(300)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    result = minhash.near_duplicates(docs_of(rows), 4)
    sets = {t: shingles(t, 4) for t in set(texts)}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in rows:
        for j, u in rows[:i]:
            both = len(sets[t] & sets[u])
            if 100 * both >= 80 * (len(sets[t]) + len(sets[u]) - both) and find(i) != find(j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    found = {r.doc_id: r.component_id for r in result.collect()}
    wrong = [i for i in found if found[i] != find(i)]
    assert len({find(i) for i, _ in rows}) > 20 and wrong == []


def test_rows_that_share_an_id(docs_of):
    a, b, c = ("x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6", "z1 z2 z3 z4 z5 z6")
    rows = [(9, a), (3, a), (9, b), (5, b), (7, c), (7, c), (8, c), (2, None), (2, "lone words")]
    component = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(rows)).collect() if r.n_shingles}
    assert component == {9: 3, 3: 3, 5: 3, 7: 7, 8: 7, 2: 2}


def test_null_ids_and_empty_tables(docs_of):
    docs = docs_of([(None, "a b c d e f"), (1, "a b c d e f")])
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()} == {(None, None, True), (1, 1, True)}
    assert minhash.near_duplicates(docs.filter("false")).collect() == []


def test_rows_that_stay(docs_of, corpus):
    docs = docs_of(corpus)
    out = minhash.drop_near_duplicates(docs, 5)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, _, kept in plain(corpus, 5) if kept)


def test_posterior_bounds():
    for n, least in minhash.least_matches(240, 80):
        chance = [sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1)) for m in (least - 1, least)]
        assert chance[0] < minhash.MISS <= chance[1]


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(2)
    x = rnd.integers(1, 2**63, 3000).astype(np.uint64)
    agree = np.mean([(minhash.signature(x[:1000 + 500]) == minhash.signature(x[500:2000], seed=minhash.SEED)).mean()])
    assert abs(agree - 0.5) < 0.12


def test_components_of_long_paths(spark):
    rnd = random.Random(1)
    ids = list(range(1, 400))
    rnd.shuffle(ids)
    links = list(zip(ids, ids[1:]))[:300] + [(5000, 5000), (6000, 6001)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in ids[:301]} == {min(ids[:301])} and found[6001] == 6000
