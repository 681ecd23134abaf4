"""Registered corpus queries: equal to their SQL twins, or complete where there is none."""

import pytest

from compare import connect, plain, rows_of
from typetrace.llm import queries
from typetrace.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cur = connect(SF).execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(map(plain, r)) for r in df.collect()]) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"pipeline"}))
def test_one_row_for_each_row(spark, name):
    source = "pages" if name.startswith("op4") else "documents"
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == table(spark, "/root/testdata/sf0.001", source).count()


def test_contracts(spark):
    want = {
        "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op3_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op4_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op6_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op7_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op9_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op10_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op11_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
        "op12_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op13_ranked_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    }
    for name, columns in want.items():
        kinds = dict(queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
        assert {c: kinds.get(c) for c in columns} == columns, name
