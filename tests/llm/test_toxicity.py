import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from typetrace.llm import toxicity
from typetrace.llm.common import crc_bucket, table

FILLER = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def pairs(spark, docs_of):
    """Toxic only where an insult meets a group's mention."""
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        insult, group = i % 2, i // 2 % 2
        words = [rnd.choice(FILLER) + str(rnd.randrange(300)) for _ in range(20)] + ["grobian"] * insult + ["marsians"] * group
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, insult & group))
    return docs_of(rows), labels_of(spark, labels)


def test_pairs_of_terms_are_learnt(pairs):
    docs, labels = pairs
    model = toxicity.fit_toxicity(docs, labels, learn=lambda i: crc_bucket(i, 5) != 0)
    got = toxicity.score_toxicity(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 2 and r.doc_id // 2 % 2) for r in got)
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 900


def test_few_labels_teach(spark, docs_of):
    """Eight toxic texts of 64, each with one of two insults: no term reaches a log likelihood ratio of 25."""
    rnd = random.Random(6)
    word = lambda: rnd.choice(FILLER) + str(rnd.randrange(300))
    rows = [(i, " ".join([word() for _ in range(30)] + [["grobian", "lumpazius"][i // 8 % 2]] * (i % 8 == 0))) for i in range(164)]
    labels = labels_of(spark, [(i, 1, int(i % 8 == 0)) for i in range(64)])
    docs = docs_of(rows)
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert {r.doc_id for r in got if r.predicted} == {i for i in range(164) if i % 8 == 0}


def test_terms_that_tell_only_as_a_pair(spark, docs_of):
    """Toxic where exactly one of two words stands: neither is tied to the label by itself."""
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        one, other = i % 2, i // 2 % 2
        rows.append((i, " ".join([rnd.choice(FILLER) + str(rnd.randrange(300)) for _ in range(20)] + ["grobian"] * one + ["marsians"] * other)))
        labels.append((i, 1, one ^ other))
    docs = docs_of(rows)
    model = toxicity.fit_toxicity(docs, labels_of(spark, labels), learn=lambda i: crc_bucket(i, 5) != 0)
    assert all(r.predicted == (r.doc_id % 2) ^ (r.doc_id // 2 % 2) for r in toxicity.score_toxicity(docs, model).collect())


def test_energy_is_the_sum_over_pairs():
    rnd = np.random.default_rng(1)
    w, v = rnd.normal(size=6), rnd.normal(size=(6, 3))
    terms = [[0, 2, 5], [1], [], [1, 3, 4, 5]]
    text, term = np.repeat(np.arange(4), list(map(len, terms))), np.array([t for x in terms for t in x])
    got = toxicity._energy(4, text, term, 0.5, w, v)[0]
    want = [0.5 + sum(w[i] for i in x) + sum(v[i] @ v[j] for i in x for j in x if i < j) for x in terms]
    assert np.allclose(got, want)


def test_odd_rows_and_labels(spark, docs_of):
    rows = [(i, "you grobian you" if i < 40 else f"kind word{i}") for i in range(200)]
    docs = docs_of(rows + [(300, None), (301, ""), (302, "!!"), (303, "GROBIAN! " * 40000), (303, "grobian"), (None, "grobian")])
    labels = labels_of(spark, [(i, 1, int(i < 40)) for i in range(200)] + [(None, 1, 1), (5, 1, None), (7, 1, 0), (999, 0, 1)])
    # Copies count once: the toxic text is one of many, but its label's mean is high.
    got = {(r.doc_id, r.predicted) for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert {(300, 0), (301, 0), (302, 0)} <= got


def test_without_labels_of_both_kinds(spark, docs_of):
    docs = docs_of([(1, "a"), (2, "b")])
    for labels, score in (([], 0.0), ([(1, 1, 0), (2, 1, 0)], 0.0), ([(1, 1, 1), (2, 1, 1)], 1.0)):
        model = toxicity.fit_toxicity(docs, labels_of(spark, labels))
        assert all(abs(r.score - score) < 1e-6 for r in toxicity.score_toxicity(docs, model).collect())
    assert toxicity.score_toxicity(docs.filter("false"), model).collect() == []


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit_toxicity(docs, labels, learn=lambda i: crc_bucket(i, 5) != 0)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter(crc_bucket(F.col("doc_id"), 5) == 0).collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.85 * sum(r.toxic for r in got) and hit >= 0.97 * sum(r.predicted for r in got)
