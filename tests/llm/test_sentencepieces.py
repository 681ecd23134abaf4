import random

import numpy as np
import pytest
import sentencepiece

from typetrace.llm import sentencepieces as sp
from typetrace.llm.common import table

ODD = ["", " ", "  ", "a", " a", "a ", "  Hello  world\n\tx ", "▁a", "a\0b", "　x", "😀x 漢字 ｆｕｌｌ", "\n", "a\nb\n", "<s> </s> <unk> <0x41>", "a" * 3000, " " * 300, "é́", "x" * 70 + "\U0010ffff"]


@pytest.fixture(scope="module")
def model():
    return sp.read_model()


def some_texts():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("ab cde  \nthinger▁é漢'.,") for _ in range(rnd.randrange(1, 200))) for _ in range(800)]


def test_ids_and_texts_agree_with_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = some_texts() + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    for text in texts:
        ids = sp.encode(model, text).tolist()
        assert ids == library.encode(text)
        assert sp.decode(model, ids) == library.decode(ids) == text.replace(sp.SPACE, " ")


def test_the_stream_needs_no_words(model):
    for text in some_texts()[:200]:
        if not text:
            continue
        whole = sp.SPACE + text.replace(" ", sp.SPACE)
        stream, ids = sp.StreamingViterbi(model), []
        for at in range(0, len(whole), 7):
            ids += stream.feed(whole[at:at + 7])
        assert ids + stream.finish() == sp.encode(model, text).tolist()


def test_what_is_held_is_bounded(model):
    stream = sp.StreamingViterbi(model)
    for _ in range(2000):
        stream.feed("thing and another ")
    assert stream.widest <= 8 * model.longest


def best_path(model, text):
    """Best sum of scores over all segmentations, by plain dynamic programming from the right."""
    best = [0.0] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        one = model.ids.get(text[i])
        best[i] = best[i + 1] + (model.worst if one is None else model.scores[one])
        for n in range(2, model.longest + 1):
            piece = model.ids.get(text[i:i + n])
            if piece is not None and i + n <= len(text):
                best[i] = max(best[i], best[i + n] + model.scores[piece])
    return best[0]


def test_unigram_models_get_the_best_sum():
    rnd = random.Random(5)
    pieces = ["<unk>"] + sorted({"".join(rnd.choice("abc▁") for _ in range(rnd.randrange(1, 7))) for _ in range(120)})
    model = sp.Model(pieces, [0.0] + [-rnd.uniform(1, 12) for _ in pieces[1:]], [2] + [1] * (len(pieces) - 1), merges=False)
    for _ in range(150):
        text = "".join(rnd.choice("abcx▁") for _ in range(rnd.randrange(1, 300)))
        stream, ids = sp.StreamingViterbi(model), []
        for at in range(0, len(text), 11):
            ids += stream.feed(text[at:at + 11])
        ids += stream.finish()
        assert abs(sum(model.worst if i == 0 else model.scores[i] for i in ids) - best_path(model, text)) < 1e-6
        assert "".join("x" if i == 0 else pieces[i] for i in ids).replace("x", "") == "".join(c for c in text if c in model.ids or c == "x").replace("x", "") or "x" in text or any(c not in model.ids for c in text)


def test_tables(spark, docs_of, model):
    rows = list(enumerate(ODD)) + [(100, None), (3, "a"), (None, "b"), (101, "word " * 100_000)]
    docs = docs_of(rows)
    got = sp.encoded_and_decoded(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_ids == len(r.ids) and (r.exact or r.doc_id == ODD.index("▁a"))
    assert sp.encoded_and_decoded(docs.filter("false"), model).collect() == []
    extra = sp.encode_texts(docs, model)
    assert extra.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    nulls = spark.createDataFrame([(None,), ([],), ([413],)], "ids array<int>")
    assert sorted(r.decoded for r in sp.decode_ids(nulls, model).collect()) == sorted(["", "", sp.decode(model, [413])])


def test_bytes_that_are_no_text(model):
    assert sp.decode(model, np.array([model.bytes[0xFF], model.bytes[0x41]])) == "�A"
