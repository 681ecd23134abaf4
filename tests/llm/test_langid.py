import random

import numpy as np
from pyspark.sql import functions as F

from typetrace.llm import langid
from typetrace.llm.common import crc_bucket, table

SF = "/root/testdata/sf0.01"


def fold(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return langid.fold(data, np.array([0, len(data)]))[0].tobytes()


def test_automaton_knows_exactly_the_substrings():
    text = b"abracadabra abba"
    steps = langid.suffix_automaton(text)

    def has(s):
        state = 0
        for c in s:
            if c not in steps[state]:
                return False
            state = steps[state][c]
        return True

    rnd = random.Random(2)
    for _ in range(2000):
        s = bytes(rnd.choice(b"abrcd ") for _ in range(rnd.randrange(1, 6)))
        assert has(s) == (s in text)


def plain_phrases(text, sample):
    n = 0
    for begin in range(0, len(text), langid.BLOCK):
        part, at = text[begin:begin + langid.BLOCK], 0
        while at < len(part):
            k = 1
            while at + k < len(part) and part[at:at + k + 1] in sample:
                k += 1
            at, n = at + k, n + 1
    return n


def test_phrases_are_longest_matches():
    samples = {"x": fold("the cat sat on the mat and the rat"), "y": fold("der hund und die katze über alles")}
    parser = langid.build_parser(samples)
    rnd = random.Random(3)
    texts = [fold("".join(rnd.choice("thecadrunükz ") for _ in range(rnd.randrange(1, 9000)))) for _ in range(30)] + [b"", b"q"]
    off = np.cumsum([0, *map(len, texts)])
    got = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), off)
    want = [[plain_phrases(t, samples[x]) for x in ("x", "y")] for t in texts]
    assert got.tolist() == want


def test_fold_keeps_letters_and_single_spaces():
    assert fold("a--b  9 ü!") == "a b ü ".encode()


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    parser = langid.fit_languages(docs, learn=lambda i: crc_bucket(i, 3) != 1)
    got = langid.identify(docs, parser).join(docs, "doc_id").filter(crc_bucket(F.col("doc_id"), 3) == 1).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(docs_of):
    train = [(i, "the cat and the dog are here", "en") for i in range(5)] + [(i, "der hund und die katze sind da", "de") for i in range(5, 10)]
    odd = [(20, None, None), (21, "", None), (22, "123 !!", None), (23, "THE CAT!!! " * 30000, None), (24, "die katze", None), (24, "die katze", None), (25, "漢字", None), (26, "KATZE!", None), (None, "the dog", None)]
    docs = docs_of(train + odd)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, langid.fit_languages(docs)).collect() if r.doc_id is None or r.doc_id >= 20 and r.doc_id != 25]
    assert sorted(((i, x) for i, x, _ in got), key=repr) == sorted([(20, "und"), (21, "und"), (22, "und"), (23, "en"), (24, "de"), (24, "de"), (26, "de"), (None, "en")], key=repr)
    assert all(s == 0 for _, x, s in got if x == "und") and all(0 <= s <= 1 for *_, s in got)


def test_whole_texts_are_learnt(docs_of):
    long = "begin " + "the cat and the dog " * 100 + "quixotic"
    docs = docs_of([(1, long, "en"), (1, long, "en"), (2, "kurz", "de"), (3, "noch einer", "de")])
    got = langid.sample_texts(docs)
    assert got["en"] == b" " + long.encode() and sorted(got["de"].split()) == [b"einer", b"kurz", b"noch"]
    many = docs_of([(i, f"wort {'abcdefghij'[i % 10]} " * 500, "de") for i in range(200)])
    assert len(langid.sample_texts(many)["de"]) == langid.SAMPLE_BYTES
    assert langid.sample_texts(many) == langid.sample_texts(many.repartition(7))


def test_nothing_to_learn_from(docs_of):
    docs = docs_of([(1, "words", None), (2, None, "en"), (3, "12", "en")])
    assert langid.fit_languages(docs) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, None).collect()} == {("und", 0.0)}
    assert langid.identify(docs.filter("false"), None).collect() == []
