import random
import re
from collections import Counter

import numpy as np

from typetrace.llm import quality
from typetrace.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(n - 1 for n in lines.values()), len(covered))


def some_texts():
    rnd = random.Random(8)
    alphabet = ["ab", "é", "😀", "#", "*x", "the", "cat", "\n", "\n", " ", "\t", "\x0b", " ", "\x85"]
    texts = [None, "", "\n\n", " ", "one", "a b c d e a b c d e", "x\nx\nx \nx", "w " * 100_000]
    return texts + ["".join(rnd.choice(alphabet) + rnd.choice(["", " "]) for _ in range(rnd.randrange(400))) for _ in range(200)]


def test_statistics_match_plain_counts(docs_of):
    texts = some_texts()
    got = quality.judge_quality(docs_of(list(enumerate(texts)) + [(4, texts[4])]), None).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)


def test_trees_keep_the_order_their_signs_ask_for():
    rnd = np.random.default_rng(3)
    x = rnd.uniform(size=(3000, 3))
    y = ((x[:, 0] + 0.2 * rnd.normal(size=3000) > 0.5) & (x[:, 1] < 0.8)).astype(float)
    model = quality.fit_trees(x, y, (1, -1, 0))
    assert ((model.score(x) > 0.5) == y).mean() > 0.85
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:200], 20, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 20), 200)
        step = np.diff(model.score(grid).reshape(200, 20), axis=1) * sign
        assert (step >= -1e-12).all()


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.judge_quality(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.97 * len(got)


def test_without_labels_or_rows(spark, docs_of):
    docs = docs_of([(1, "w " * 20), (2, " ".join(map(str, range(20))))])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    assert model is None
    assert sorted((r.doc_id, r.kept) for r in quality.judge_quality(docs, model).collect()) == [(1, False), (2, True)]
    assert quality.judge_quality(docs.filter("false"), model).collect() == []
