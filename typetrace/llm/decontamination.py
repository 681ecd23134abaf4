"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``WIDTH`` consecutive words of a benchmark item; an item of fewer words is one pattern.
Words of the items are numbered, any other word of a document is 0. For the patterns of one length m, a table
over hashed blocks of two words says how far a search may move on: to the nearest place of that block in any
pattern, or by m - 1 words if it is in none. Where it says 0, the patterns that end in that block are
looked up by the hash of their last and first blocks, and compared word by word. Documents
are searched from many places at once, each moving on by its own shifts.

Tables are built for at most ``tokens.ITEM_BYTES`` of item texts and broadcast. More items are searched for
part after part; what was found goes along with the row, so no document is shuffled.

Defined results: null and word-free texts have no words, no hits and no items; repeated rows get the same result each;
null items and items without words are found nowhere; texts that share an item id are one item with all
their windows; an item without an id has the empty name. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb
from typetrace.llm.common import stored
from typetrace.llm.tokens import item_parts, lower_words, ranges

WIDTH = 10
TABLE = 1 << 20  # entries of a shift table
STRIDE = 256  # window ends that one place of the search covers
PAIRS = 1 << 20  # comparisons made at a time


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tb.mix(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))


@dataclass(frozen=True)
class Shifts:
    """Patterns of one length, with their shift table and suffix buckets."""

    patterns: np.ndarray  # one row each, sorted by bucket
    bucket: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, patterns: np.ndarray) -> tuple[Shifts, np.ndarray]:
        """Tables of distinct patterns, and the order their rows were put into."""
        m = patterns.shape[1]
        shift = np.full(TABLE, max(1, m - 1), np.int32)
        for last in range(min(1, m - 1), m):  # the block that ends at ``last`` lets the search move on to the pattern's end
            slot = (_block(patterns[:, max(0, last - 1)], patterns[:, last]) % np.uint64(TABLE)).astype(np.int64)
            shift[slot] = m - 1 - last
        bucket = cls.buckets(patterns)
        order = np.argsort(bucket, kind="stable")
        return cls(patterns[order], bucket[order], shift), order

    @staticmethod
    def buckets(windows: np.ndarray) -> np.ndarray:
        m = windows.shape[1]
        return tb.mix(_block(windows[:, max(0, m - 2)], windows[:, m - 1]) + _block(windows[:, 0], windows[:, min(1, m - 1)]) * np.uint64(3))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, pattern) of every occurrence."""
        m = self.patterns.shape[1]
        at = np.arange(m - 1, len(words), STRIDE)
        end = np.minimum(at + STRIDE, len(words))
        stops = [np.zeros(0, np.int64)]
        while len(at):
            move = self.shift[(_block(words[at - min(1, m - 1)], words[at]) % np.uint64(TABLE)).astype(np.int64)]
            stops.append(at[move == 0])
            at = at + np.maximum(move, 1)
            left = at < end
            at, end = at[left], end[left]
        first = np.concatenate(stops) - (m - 1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        windows = lambda at: words[at[:, None] + np.arange(m)]
        for k in range(0, len(first), PAIRS // 16):
            some = first[k:k + PAIRS // 16]
            key = self.buckets(windows(some))
            low = np.searchsorted(self.bucket, key, "left")
            count = np.searchsorted(self.bucket, key, "right") - low
            some, low, count = some[count > 0], low[count > 0], count[count > 0]
            ends = np.cumsum(count)
            row = 0
            while row < len(some):  # as many candidates at a time as fit
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
                which, pattern = ranges(low[row:stop], count[row:stop])
                same = (windows(some[row:stop][which]) == self.patterns[pattern]).all(axis=1)
                found.append((some[row:stop][which[same]], pattern[same]))
                row = stop
        return tuple(np.concatenate(x) for x in zip(*found))


@dataclass(frozen=True)
class Patterns:
    """Windows of a part of the items: their words, names, and the tables of each length."""

    vocabulary: pa.Array
    names: list[str]  # in the order of their bytes
    lengths: list[tuple[Shifts, np.ndarray, np.ndarray]]  # tables, then the items of pattern p: items[ends[p]:ends[p + 1]]

    @classmethod
    def of(cls, part: pa.Table, width: int = WIDTH) -> Patterns:
        ids = pc.fill_null(part.column("item").cast(pa.string()), "").to_pylist()
        names = sorted(set(ids))
        place = {name: k for k, name in enumerate(names)}
        item = np.array([place[i] for i in ids], np.int64)
        words, first = lower_words(*tb.utf8(part.column("text")))
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        count = np.diff(first)
        lengths = []
        for m in np.unique(np.minimum(count, width)).tolist():
            if not m:
                continue
            rows = np.flatnonzero(count == m) if m < width else np.flatnonzero(count >= m)
            which, at = ranges(first[rows], count[rows] - m + 1)
            windows, kind = np.unique(code[at[:, None] + np.arange(m)], axis=0, return_inverse=True)
            tables, order = Shifts.of(windows)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            pair = np.unique(back[kind.ravel()] * len(names) + item[rows][which])
            lengths.append((tables, pair % len(names), np.searchsorted(pair // len(names), np.arange(len(order) + 1))))
        return cls(coded.dictionary, names, lengths)

    def scan(self, words: pa.Array, first: np.ndarray):
        """Cover of words by occurrences, and distinct (text, item) pairs in order."""
        n_texts = len(first) - 1
        text = np.repeat(np.arange(n_texts), np.diff(first))
        # A 0 stands between texts, so no window reaches over.
        symbols = np.zeros(len(text) + n_texts, np.int64)
        if len(text):
            symbols[np.arange(len(text)) + text] = pc.fill_null(pc.add(pc.index_in(words, self.vocabulary), 1), 0).to_numpy(zero_copy_only=False)
        edge = np.zeros(len(symbols) + 1, np.int64)
        owner = np.concatenate([text + np.arange(len(text)), np.zeros(0, np.int64)])
        whose = np.repeat(np.arange(n_texts), np.diff(first) + 1)
        pairs = [np.zeros(0, np.int64)]
        for tables, items, ends in self.lengths:
            at, pattern = tables.find(symbols)
            edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + tables.patterns.shape[1], minlength=len(edge))
            which, k = ranges(ends[pattern], ends[pattern + 1] - ends[pattern])
            pairs.append(np.unique(whose[at[which]] * len(self.names) + items[k]))
        pair = np.unique(np.concatenate(pairs))
        return np.cumsum(edge)[owner] > 0, pair // max(1, len(self.names)), pair % max(1, len(self.names))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _search(rows: DataFrame, shared) -> DataFrame:
    """``rows`` (``doc_id``, ``text`` and what was found so far) after a part of the items."""

    def scan(batches):
        patterns = shared.value
        for some, data, off in tb.slices(batches):
            words, first = lower_words(data, off)
            hit, text, item = patterns.scan(words, first)
            before = some.column("spans")
            count = before.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            old = before.flatten()
            edge = np.zeros(len(hit) + 1, np.int64)
            if len(old):
                base = np.repeat(first[:-1], count)
                np.add.at(edge, base + old.field("start").to_numpy(), 1)
                np.add.at(edge, base + old.field("end").to_numpy(), -1)
            hit |= np.cumsum(edge)[:-1] > 0
            start, end, each = tb.spans(hit, first)
            base = np.repeat(first[:-1], np.diff(each))
            spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], fields=list(SPAN))
            items = some.column("items").to_pylist()
            cut = np.searchsorted(text, np.arange(len(items) + 1))
            for k in np.unique(text).tolist():
                items[k] = sorted({*items[k], *(patterns.names[i] for i in item[cut[k]:cut[k + 1]].tolist())})
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("text"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), spans),
                 pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, text string, {FOUND}")


def find_benchmark(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (runs of hit words: first, and first after) and ``items`` (names in order) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
                       F.expr("cast(array() as array<struct<start: long, end: long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for k, part in enumerate(item_parts(items, item_col, item_text)):
        rows = _search(stored(rows, "searched") if k else rows, spark.sparkContext.broadcast(Patterns.of(part, width)))
    return rows.drop("text")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Counts and the digest of the found items' names for every row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find_benchmark(docs, items, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
