"""Language identification by cross-parsing entropy.

For each language, labelled texts in the order of their ids' hashes, whole until ``SAMPLE_BYTES`` are full, become a suffix automaton, which knows every
substring of it. A text is parsed against each language from left to right into phrases: the longest
match, then the next. A language's entropy is phrases x log2(sample length) / text length, and the
least one wins. Automata are flattened into one table (state, symbol) -> next state, whose lowest bit says that a
phrase begins, so a batch of texts is parsed in lockstep, one symbol of every block and
language at a time. Parsing starts anew every ``BLOCK`` symbols, which adds one phrase a block to
every language alike.

Text is lower-cased; what is no letter is one space; symbols are UTF-8 bytes.

Defined results: null or a text without a letter is ``und`` with score 0.0; so is every text if
nothing can be learnt; ties go to the smaller language code; a repeated row gets the same result.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb

SAMPLE_BYTES = 32_768  # of each language
BLOCK = 2048
SHARPNESS = 32.0  # symbols of evidence that turn a difference of entropies into a score
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 256)]] = [*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 256)]


def fold(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of lower-cased texts, with one space for each run of anything else."""
    text = _FOLD[data]
    space = text == 0x20
    keep = ~space
    if len(text) > 1:
        keep[1:] |= ~space[:-1]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(text))]
        keep[cuts] = ~space[cuts]
    total = np.zeros(len(text) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return text[keep], total[off]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for symbol in text:
        here = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = here
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    return step


@dataclass(frozen=True)
class Parser:
    """Tables of all languages together: ``table[state * width + symbol]`` is the next state's row and, in the lowest bit, whether a phrase began."""

    langs: tuple[str, ...]
    symbol: np.ndarray
    width: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    def phrases(self, text: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        code = self.symbol[text]
        sizes = np.diff(off)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        first = np.cumsum(blocks) - blocks
        start = off[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        length = np.minimum(start + BLOCK, off[owner + 1]) - start
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for at, k in enumerate(active):  # blocks still longer than ``at``
            got = self.table[state[:, :k] + code[start[:k] + at]]
            count[:, :k] += got & 1
            state[:, :k] = got >> 1
        out = np.zeros((len(sizes), len(self.langs)))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(owner[order], weights=count[i], minlength=len(sizes))
        return out

    def entropy(self, text: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits a symbol of each text in each language."""
        return self.phrases(text, off) * self.bits / np.maximum(np.diff(off), 1)[:, None]


def build_parser(samples: dict[str, bytes]) -> Parser:
    """Flatten the automata of folded sample texts by language."""
    langs = tuple(sorted(samples))
    used = sorted(set().union(*map(set, samples.values())))
    width = len(used) + 1  # the last symbol is any that no sample has
    symbol = np.full(256, width - 1, np.int32)
    symbol[used] = np.arange(len(used))
    tables, roots, states = [], [], 0
    for lang in langs:
        steps = suffix_automaton(samples[lang])
        row = np.full((len(steps), width), -1, np.int64)
        for s, to in enumerate(steps):
            for c, t in to.items():
                row[s, symbol[c]] = t
        begin = np.where(row[0] >= 0, row[0], 0)
        fresh = row < 0
        fresh[0] = True
        tables.append((np.where(row >= 0, row, begin) + states) * width * 2 + fresh)
        roots.append(states * width)
        states += len(steps)
    table = np.concatenate(tables).reshape(-1)
    small = np.int32 if states * width * 2 + 1 < 2**31 else np.int64
    return Parser(langs, symbol, width, table.astype(small), np.array(roots, small), np.log2([max(2, len(samples[x])) for x in langs]))


def sample_texts(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Folded sample of each language: whole texts in the order of their hashes until ``size`` bytes are full; only the last one is cut.

    Each task passes on its own first texts of each language, as many as fill ``size``; those of all
    tasks together hold the first ones of all, which a running sum finds.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("id is not null and lang is not null and text is not null")
    if learn is not None:
        rows = rows.filter(learn(F.col("id")))
    rows = rows.filter(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("id", F.lit(3)).alias("hash"), F.lower("text").alias("text"))

    def first(batches):
        held: dict[str, list[tuple[int, bytes]]] = {}
        for batch in batches:
            text = batch.column("text")
            for k, (lang, at) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist())):
                own = held.setdefault(lang, [])
                full = sum(len(t) + 1 for _, t in own) >= size
                if full and at > own[-1][0]:
                    continue
                data = np.frombuffer(text[k].as_py().encode(), np.uint8)
                new = (at, fold(data, np.array([0, len(data)]))[0].tobytes()[:size])
                if new in own:
                    continue
                own.append(new)
                own.sort()
                while sum(len(t) + 1 for _, t in own[:-1]) >= size:
                    own.pop()
        flat = [(lang, at, t) for lang, own in held.items() for at, t in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.binary())], ["lang", "hash", "text"])

    before = F.sum(F.length("text") + 1).over(Window.partitionBy("lang").orderBy("hash", "text").rowsBetween(Window.unboundedPreceding, -1))
    got = rows.mapInArrow(first, "lang string, hash long, text binary").distinct().withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < size)
    out: dict[str, bytes] = {}
    for lang, _, text in sorted((r.lang, r.hash, bytes(r.text)) for r in got.collect()):
        out[lang] = (out.get(lang, b"") + b" " + text)[:size]
    return out


def fit_languages(docs: DataFrame, learn=None, **options) -> Parser | None:
    samples = sample_texts(docs, learn, **options)
    return build_parser(samples) if samples else None


def identify(docs: DataFrame, parser: Parser | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``entropy`` (of the winner) of every row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(parser)

    def judge(batches):
        model = shared.value
        for rows, data, off in tb.slices(batches):
            letter = rows.column("letter").to_numpy(zero_copy_only=False)
            if model is None:
                best, score, least = None, np.zeros(len(letter)), np.zeros(len(letter))
                names = np.full(len(letter), "und", object)
            else:
                text, at = fold(data, off)
                entropy = model.entropy(text, at)
                best = np.argmin(entropy, axis=1)
                least = entropy[np.arange(len(best)), best]
                sure = np.minimum(np.maximum(np.diff(at), 1), SHARPNESS)[:, None]
                score = np.where(letter, 1 / np.exp2((least[:, None] - entropy) * sure).sum(axis=1), 0.0)
                least = np.where(letter, least, 0.0)
                names = np.where(letter, np.array(model.langs, object)[best], "und")
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(least)],
                                             ["doc_id", "lang_pred", "score", "entropy"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"),
                        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return texts.mapInArrow(judge, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, entropy double")
