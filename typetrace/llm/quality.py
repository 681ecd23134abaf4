"""Quality rules: gradient-boosted trees over statistics of a document.

The statistics are worked out on the bytes of whole texts, batch by batch. The trees are fitted on a
bounded sample of labelled rows (``rows``) and flattened into NumPy arrays of nodes; a batch walks
all trees level by level. On features with a sign, every split keeps the order its sign asks for, and
the leaves below stay on their side of the split's middle, so more symbols, repeated lines or
repeated words never raise a score.

Defined results: null counts as empty; a text without words fails the base rules; without labels
of both kinds every score is 1.0, so the base rules alone decide. A repeated row gets the same result each
time. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb
from typetrace.llm.training import labelled_texts

ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 3, 64, 0.2, 20, 1.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# A feature's sign: -1 if more of it may only lower the score, 0 if free.
FEATURES = {"words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": 0, "digits": 0,
            "marks": 0, "distinct_words": 0, "line_words": 0}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOLS = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_MARKS = _table(b"!?.,;:-_()[]{}\"'/\\")
_WINDOW = 5


def _equal_before(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (text, key), and for each place in that order: is it equal to the one before, or after."""
    order = np.argsort(tb.mix(key ^ tb.mix(text.astype(np.uint64) + np.uint64(1))), kind="stable")
    k, t = key[order], text[order]
    same = np.zeros(len(key) + 1, bool)
    if len(key):
        same[1:-1] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    return order, same[:-1], same[1:]


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base statistics of each text, and the feature matrix."""
    start, end, first = tb.words(data, off)
    n_words = np.diff(first)
    in_word = ~tb.WHITE[data]
    hashes = tb.SpanHash(data)
    word = hashes(start, end)
    text = np.repeat(np.arange(len(n_words)), n_words)

    # Lines: the ends of texts cut as newlines do.
    line_start, line_end, line_first = tb.spans(data != 10, off)
    line_words = np.searchsorted(start, line_end) - np.searchsorted(start, line_start)
    line_text = np.repeat(np.arange(len(n_words)), np.diff(line_first))
    with_word = line_words > 0
    line_text = line_text[with_word]
    n_lines = np.bincount(line_text, minlength=len(n_words))
    order, again, _ = _equal_before(hashes(line_start[with_word], line_end[with_word]), line_text)
    n_dup_lines = np.bincount(line_text[order][again], minlength=len(n_words))

    window, at = tb.windows_of(word, first, _WINDOW)
    order, before, after = _equal_before(window, text[at])
    twice = at[order[before | after]]
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + _WINDOW, -1)
    n_repeat_words = np.bincount(text[np.cumsum(edge)[:-1] > 0], minlength=len(n_words))

    order, again, _ = _equal_before(word, text)
    distinct = n_words - np.bincount(text[order][again], minlength=len(n_words))

    counts = {"n_words": n_words, "word_chars": tb.per_text(in_word & ((data & 0xC0) != 0x80), off),
              "n_symbols": tb.per_text(_SYMBOLS[data], off), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
    many, chars = np.maximum(n_words, 1), np.maximum(counts["word_chars"], 1)
    features = np.stack([
        n_words, counts["word_chars"] / many, counts["n_symbols"] / many, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / many,
        tb.per_text(_UPPER[data], off) / chars, tb.per_text(_DIGIT[data], off) / chars, tb.per_text(_MARKS[data], off) / chars,
        distinct / many, n_words / np.maximum(n_lines, 1)], axis=1).astype(np.float64)
    return counts, features


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees, one row a tree, children of node i at 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
              bins: int = BINS, least: int = LEAST, ridge: float = RIDGE) -> Trees:
    """Boosted logistic trees by histograms, with monotonic constraints by sign of feature."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    nodes, leaves = 2 ** (depth + 1) - 1, 2 ** depth
    feature, limit, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    rate_of = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(rate_of / (1 - rate_of)))
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for level in range(depth):
            for here in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == here)
                best = (1e-6, None)
                if len(rows) >= 2 * least:
                    gr, hr = g[rows], h[rows]
                    gs, hs = gr.sum(), hr.sum()
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        c = coded[rows, f]
                        gl, hl, nl = (np.cumsum(np.bincount(c, weights=w, minlength=len(e) + 1))[:-1] for w in (gr, hr, np.ones(len(rows))))
                        wl, wr = (np.clip(-a / (b + ridge), low[here], high[here]) for a, b in ((gl, hl), (gs - gl, hs - hl)))
                        gain = gl**2 / (hl + ridge) + (gs - gl)**2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        ok = (nl >= least) & (len(rows) - nl >= least) & (signs[f] * (wr - wl) >= 0)
                        if ok.any():
                            k = int(np.argmax(np.where(ok, gain, -np.inf)))
                            if gain[k] > best[0]:
                                best = (gain[k], (f, k, wl[k], wr[k]))
                left, right = 2 * here + 1, 2 * here + 2
                low[left] = low[right] = low[here]
                high[left] = high[right] = high[here]
                if best[1] is None:  # no limit is passed: all go left
                    node[rows] = left
                    continue
                f, k, wl, wr = best[1]
                feature[t, here], limit[t, here] = f, edges[f][k]
                middle = (wl + wr) / 2
                if signs[f] < 0:
                    low[left], high[right] = middle, middle
                elif signs[f] > 0:
                    high[left], low[right] = middle, middle
                node[rows] = np.where(coded[rows, f] > k, right, left)
        for leaf in range(nodes - leaves, nodes):
            rows = node == leaf
            if rows.any():
                value[t, leaf] = rate * np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low[leaf], high[leaf])
        total += value[t, node]
    return Trees(start, feature, limit, value, depth)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS, **options) -> Trees | None:
    """Trees from about ``rows`` labelled rows; None if they are not of both kinds."""

    def extract(batches):
        for rows_, data, off in tb.slices(batches):
            _, x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), rows_.column("y")], ["x", "y"])

    sample = labelled_texts(docs, labels, "quality", rows)
    got = sample.mapInArrow(extract, "x array<double>, y double").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T[::-1], y))  # the order of arrival must not matter
    x, y = x[order], y[order]
    if len(y) < 2 * LEAST or y.min() >= 0.5 or y.max() < 0.5:
        return None
    return fit_trees(x, y, list(FEATURES.values()), **options)


def judge_quality(docs: DataFrame, model: Trees | None, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every row; ``kept`` needs the base rules and a score of ``cut``."""

    def judge(batches):
        for rows_, data, off in tb.slices(batches):
            counts, x = statistics(data, off)
            score = model.score(x) if model else np.ones(len(x))
            failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
            yield pa.RecordBatch.from_arrays(
                [rows_.column("doc_id"), *[pa.array(counts[c].astype(np.int64)) for c in BASE],
                 pa.array(failed), pa.array(~failed & (score >= cut)), pa.array(score)],
                ["doc_id", *BASE, "base_failed", "kept", "score"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, score double")
