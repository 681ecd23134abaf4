"""Registered queries of the corpus operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from typetrace.llm import (collocations, decontamination, exact_dedup, html_text, langid, licences, minhash, mixing, quality, ranked_search,
                           sentencepieces, suffix_dedup, toxicity)
from typetrace.llm.common import crc_bucket, table

# ASCII capitals only; lower() would change other letters too.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = langid.fit_languages(docs, learn=lambda i: crc_bucket(i, 3) != 1)
    return langid.identify(docs, parser).withColumn("held_out", F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)))


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded_and_decoded(table(spark, sf_dir, "documents"), sentencepieces.read_model())


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       sha256(coalesce(text, '')) AS text_sha256, doc_id = max(doc_id) OVER same AS kept
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query(licences.scan_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.known_licences(spark))


@query()
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query()
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), learn=lambda i: crc_bucket(i, 5) != 0)
    return toxicity.score_toxicity(docs, model).withColumn("held_out", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)))


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query()
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query(rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
occurrence AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM piece, (VALUES (1), (2), (3)) v(k), unnest(range(1, len(w) - k + 2)) t(s)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM occurrence GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidate AS (SELECT *, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
cut AS (SELECT p.lang, p.k, p.phrase, p.a, cut, x.c AS l, y.c AS r, (1000000::HUGEINT * p.a * p.a // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM candidate p, (VALUES (1), (2)) v(cut)
  JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:cut], ' ')
  JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[cut + 1:], ' ')
  WHERE cut < p.k),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer FROM candidate, (VALUES (1), (2)) v(s) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT p.* FROM lowest p LEFT JOIN around o ON p.lang = o.lang AND p.phrase = o.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * p.a)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER best <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(s) WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM p),
v AS (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM d, m, unnest(range(1, len(w) - m + 2)) t(s)),
h AS (SELECT r, s, m, item FROM v JOIN p USING (m, phrase)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, s, m FROM h), unnest(range(s, s + m)) t(x) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""")
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT row_number() OVER () AS k, item_id, {_ALNUM} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT k, term, count(*) AS times FROM (SELECT k, unnest(w) AS term FROM i) GROUP BY ALL),
weighed AS (SELECT k, term, times, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight FROM asked JOIN df USING (term), total),
scored AS (SELECT k, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * n_docs) // n_terms))))::BIGINT AS score
  FROM weighed JOIN tf USING (term) JOIN d USING (r), total GROUP BY k, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scored JOIN d USING (r) JOIN i USING (k) WHERE score > 0) WHERE rank <= 20
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
