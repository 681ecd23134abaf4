"""The pipeline's stages on the small tables, each held against a plain version on its own input."""

import re

import pytest

import corpus_pipeline as cp
from test_minhash import plain as near_plain
from test_mixing import check as check_mix
from typetrace.llm import mixing, queries, sentencepieces, toxicity
from typetrace.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in cp.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF), name)
    return out


def test_columns(outputs):
    names = [n for n, _ in cp.STAGES]
    assert all(outputs[n].columns == outputs["documents"].columns for n in names[:-1])


def test_filters(spark, outputs):
    read = lambda n: [(r.doc_id, r.text) for r in outputs[n].collect()]
    model = toxicity.fit_toxicity(outputs["documents"], table(spark, SF, "labels"), learn=lambda i: queries.crc_bucket(i, 5) != 0)
    good = {r.doc_id for r in toxicity.score_toxicity(outputs["documents"], model).filter("predicted = 0").collect()}
    assert {i for i, _ in read("toxicity")} == good
    largest = {}
    for i, t in read("toxicity"):
        largest[t] = max(largest.get(t, -1), i)
    assert sorted(i for i, _ in read("exact_dedup")) == sorted(largest.values())
    assert sorted(i for i, _ in read("near_dedup")) == sorted(i for i, _, _, kept in near_plain(read("exact_dedup"), 5) if kept)


def test_mix_and_ids(outputs):
    kept = outputs["near_dedup"]
    check_mix([(r.doc_id, r.text, r.lang, r.source) for r in kept.collect()], mixing.mix_sources(kept).collect())
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(kept).collect()}
    mixed = outputs["mixing"].collect()
    assert len(mixed) == sum(copies.values())
    model = sentencepieces.read_model()
    text = {r.doc_id: r.text for r in mixed}
    encoded = outputs["sentencepiece"].collect()
    assert len(encoded) == len(mixed)
    assert all(sentencepieces.decode(model, r.ids) == re.sub(sentencepieces.SPACE, " ", text[r.doc_id]) for r in encoded[:50])


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").filter("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
