import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from typetrace.llm import suffix_dedup as sd
from typetrace.llm.common import table


def plain(rows, size=sd.SIZE):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p:p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if count[b[p:p + size]] > 1:
                edge[p] += 1
                edge[p + size] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        starts = np.diff(np.concatenate([[0], gone.astype(int)])) > 0
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int(starts.sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    word = lambda n=6: "".join(rnd.choice("abcdefé") for _ in range(n))
    text = lambda n: " ".join(word(rnd.randrange(1, 9)) for _ in range(n))
    passage, copy = text(80), text(300)
    rows = [text(rnd.randrange(1, 200)) for _ in range(60)]
    rows += [f"{text(20)} {passage} {text(30)}" for _ in range(40)]
    rows += [copy, copy, copy[:900], copy[5:700] + text(9) + copy[700:], None, "", "x" * 199, "x" * 200, "z" * 200, "z" * 200, "y" * 450, "ab" * 400, "q" * 201]
    near = copy.split(" ")
    for _ in range(30):
        words = list(near)
        words[rnd.randrange(len(words))] = "changed"
        rows.append(" ".join(words))
    once = text(60)
    rows.append(once + text(20) + once)
    return list(enumerate(rows))


def test_removed_bytes_match_a_plain_count(docs_of, corpus):
    assert got(sd.remove_repeats(docs_of(corpus))) == plain(corpus)


def test_crowded_anchors_give_the_same(docs_of, corpus):
    assert got(sd.remove_repeats(docs_of(corpus), crowd=2)) == plain(corpus)


def test_repeated_rows_ids_and_extra_columns(docs_of):
    rnd = random.Random(2)
    a, b = ("".join(rnd.choice("abcdef ") for _ in range(600)) for _ in range(2))
    rows = [(1, a), (1, a), (2, b), (2, a[:100] + b[:50]), (None, b[:250]), (None, "x"), (3, a[:199])]
    assert got(sd.remove_repeats(docs_of(rows))) == plain(rows)
    assert got(sd.remove_repeats(docs_of(rows).filter("false"))) == []


def test_long_texts_are_cut_into_pieces():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"abcd") for _ in range(5000)) + b"e" * 500
    data = np.frombuffer(text, np.uint8)
    whole = sd.runs_of(data, np.array([0, len(text)]))
    assert (whole[2] - whole[1] + 1).sum() == len(text) - sd.SIZE + 1
    pieces = [(a, min(len(text), a + 700 + sd.SIZE - 1)) for a in range(0, len(text) - sd.SIZE + 1, 700)]
    starts = np.concatenate([np.arange(f, e + 1) + a for a, b in pieces for f, e in zip(*sd.runs_of(data[a:b], np.array([0, b - a]))[1:3])])
    assert sorted(starts.tolist()) == list(range(len(text) - sd.SIZE + 1))


def test_two_stages_give_the_sorted_order():
    rnd = random.Random(4)
    for size in (8, 20):
        for alphabet in (b"ab", b"abcdefgh", b"a", bytes(range(256))):
            raw = bytes(rnd.choice(alphabet) for _ in range(700)) + bytes(size)
            text = np.frombuffer(raw, np.uint8)
            wanted = np.zeros(len(text), bool)
            wanted[[i for i in range(700 - size) if rnd.random() < 0.7]] = True
            order = sd.two_stage_order(text, wanted, size)
            keys = [raw[i:i + size] for i in order]
            assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
            assert keys == sorted(keys)
            count = Counter(keys)
            assert np.flatnonzero(sd.repeated_starts(text, wanted, size)).tolist() == [i for i in np.flatnonzero(wanted).tolist() if count[raw[i:i + size]] > 1]


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(sd.remove_repeats(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
