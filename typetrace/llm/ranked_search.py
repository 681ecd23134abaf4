"""Ranked lexical search by K2-treaps over term-document grids.

Documents are dealt in blocks. A block's grid has a row for each term, a column for each document (by ascending
id) and in each filled place the impact ``(10**9 * tf) div (1000 * tf + 12 * m)``. It is kept as a quadtree:
level by level, four bits a cell say which quarters are filled, and each filled quarter keeps
how far its largest impact lies under that of its cell. An item's terms are rows; their paths go down the tree together.
A range of documents is bounded by the sum, over the item's terms, of weight times the largest impact of the cell that
holds the term's row and the range. Ranges are opened best first, in runs of up to ``OPENED`` ranges of one level; a range whose
bound lies under the twentieth score found so far by the task is not opened. At single columns the bound is the score.

Every task gives out at most ``top`` documents an item, whatever the number of its blocks; windows rank those.
Items are searched for in parts of bounded size (``tokens.ITEM_BYTES``), an index of their terms each; without terms,
``build_index`` indexes all.

Defined results: null and word-free texts match nothing and count in neither N nor L; an item without words, or
whose words stand nowhere, has no rows; equal items (id and text) are asked once, other texts under the same id are ranked on
their own; equal scores go by ascending id, nulls first; every repeated row is a document of its own. Other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb
from typetrace.llm.common import stored
from typetrace.llm.tokens import item_parts, lower_words, ranges

TOP = 20
BLOCK_DOCS, BLOCK_TERMS = 4096, 1 << 21  # a block ends with the text that reaches either
OPENED = 512
_ONES = np.array([bin(k).count("1") for k in range(16)], np.int64)
INDEX = "terms array<string>, df array<int>, side int, bits array<binary>, drops array<binary>"


def _postings(docs: DataFrame, shared) -> DataFrame:
    """Blocks of documents: ids, lengths, terms with the number of documents each, and (term, column, tf) of every place filled."""

    def block(parts):
        ids = pa.concat_arrays([p[0] for p in parts])
        by_id = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        column = np.empty(len(by_id), np.int64)
        column[by_id] = np.arange(len(by_id))
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        terms = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
        names = terms.dictionary
        order = pc.array_sort_indices(names).to_numpy()
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        term = row[terms.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
        doc = column[np.concatenate([p[3] + b for p, b in zip(parts, base)])]
        tf = np.concatenate([p[4] for p in parts])
        return [ids.take(pa.array(by_id)), np.concatenate([p[1] for p in parts])[by_id], names.take(pa.array(order)).cast(pa.string()),
                np.bincount(term, minlength=len(order)).astype(np.int32), *(x.astype(np.int32).tobytes() for x in (term, doc, tf))]

    def one(values):
        ids, n, names, df, *places = values
        single = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([single(ids), single(pa.array(n.astype(np.int32))), single(names), single(pa.array(df)), *(pa.array([p], pa.binary()) for p in places)],
                                          ["ids", "n", "terms", "df", "term", "doc", "tf"])

    def count(batches):
        wanted = shared.value if shared else None
        parts, docs_, filled = [], 0, 0
        for rows, data, off in tb.slices(batches):
            words, first = lower_words(data, off)
            text = np.repeat(np.arange(len(off) - 1), np.diff(first))
            if wanted is None:
                coded = words.dictionary_encode()
                code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            else:
                code, names = pc.fill_null(pc.index_in(words, wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64), wanted
                text, code = text[code >= 0], code[code >= 0]
            pair, tf = np.unique(text * max(1, len(names)) + code, return_counts=True)
            at, term = pair // max(1, len(names)), pair % max(1, len(names))
            ids = rows.column("doc_id")
            parts.append((ids, np.diff(first), names.take(pa.array(term)), at, tf))
            docs_, filled = docs_ + len(ids), filled + len(term)
            if docs_ >= BLOCK_DOCS or filled >= BLOCK_TERMS:
                yield one(block(parts))
                parts, docs_, filled = [], 0, 0
        if parts:
            yield one(block(parts))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"ids array<{kind}>, n array<int>, terms array<string>, df array<int>, term binary, doc binary, tf binary")


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """Bits of ``x`` at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _least_type(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


@dataclass(frozen=True)
class Treap:
    """A grid as levels of cells; ``first[l][c]`` is the first quarter, on level l + 1, of cell c of level l."""

    height: int
    quarters: list[np.ndarray]
    first: list[np.ndarray]
    most: list[np.ndarray]

    @staticmethod
    def pack(rows: int, columns: int, row: np.ndarray, column: np.ndarray, impact: np.ndarray) -> tuple[int, list[bytes], list[bytes]]:
        """Height, bits and drops of a grid; the first drop is the largest impact itself."""
        height = max(1, (max(rows, columns, 1) - 1).bit_length())
        code = _spread_bits(row) << np.uint64(1) | _spread_bits(column)
        order = np.argsort(code)
        code, most = code[order], impact[order].astype(np.int64)
        bits, drops = [], []
        for _ in range(height):
            above = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(above) else np.zeros(0, np.int64)
            top = np.maximum.reduceat(most, start) if len(start) else most
            quarter = np.add.reduceat(1 << (code & np.uint64(3)).astype(np.int64), start) if len(start) else start
            nibbles = np.append(quarter, 0)[:(len(quarter) + 1) // 2 * 2].astype(np.uint8)
            bits.append((nibbles[::2] | nibbles[1::2] << 4).tobytes())
            drop = _least_type(np.repeat(top, np.diff(np.append(start, len(code)))) - most)
            drops.append(bytes([drop.itemsize]) + drop.tobytes())
            code, most = above[start], top
        drop = _least_type(most)
        drops.append(bytes([drop.itemsize]) + drop.tobytes())
        return height, bits[::-1], drops[::-1]

    @classmethod
    def load(cls, height: int, bits: list[bytes], drops: list[bytes]) -> Treap:
        drops = [np.frombuffer(d[1:], f"u{d[0]}").astype(np.int64) for d in drops]
        quarters, first, most = [], [], [drops[0]]
        for packed, drop in zip(bits, drops[1:]):
            packed = np.frombuffer(packed, np.uint8)
            nibbles = np.stack([packed & 15, packed >> 4], axis=1).ravel()[:len(most[-1])].astype(np.int64)
            ends = np.cumsum(_ONES[nibbles])
            quarters.append(nibbles)
            first.append(ends - _ONES[nibbles])
            most.append(np.repeat(most[-1], _ONES[nibbles]) - drop)
        return cls(height, quarters, first, most)

    def search(self, rows: np.ndarray, weights: np.ndarray, floor: int, top: int) -> list[tuple[int, int]]:
        """The best (score, column), by descending score and ascending column, of scores of ``floor`` or more (and of 1)."""
        bound = int((weights * self.most[0][0]).sum()) if len(self.most[0]) else 0
        best: list[tuple[int, int]] = []
        floor = max(1, floor)
        # A run: level, bounds in descending order, column ranges, and the terms and cells of each range.
        run = (0, np.array([bound]), np.zeros(1, np.int64), np.array([0, len(rows)]), np.arange(len(rows)), np.zeros(len(rows), np.int64))
        heap, serial = [(-bound, 0, run, 0)], 1
        while heap and -heap[0][0] >= floor:
            _, _, run, at = heapq.heappop(heap)
            level, bounds, column, ends, term, cell = run
            stop = min(at + OPENED, int(np.searchsorted(-bounds, -floor, "right")))
            if stop < len(bounds):
                heapq.heappush(heap, (-int(bounds[stop]), serial, run, stop))
                serial += 1
            opened = self._open(level, column[at:stop], ends[at:stop + 1], term[ends[at]:ends[stop]], cell[ends[at]:ends[stop]], rows, weights, floor)
            if opened is None:
                continue
            if level + 1 < self.height:
                heapq.heappush(heap, (-int(opened[1][0]), serial, opened, 0))
                serial += 1
                continue
            score, column = opened[1], opened[2]
            some = np.lexsort((column, -score))[:top]
            best = sorted(best + list(zip((-score[some]).tolist(), column[some].tolist())))[:top]
            if len(best) == top:
                floor = max(floor, -best[-1][0])
        return [(-s, c) for s, c in best]

    def _open(self, level, column, ends, term, cell, rows, weights, floor):
        """The halves of ranges, as a run of the next level; those under ``floor`` are left out."""
        node = np.repeat(np.arange(len(column)), np.diff(ends))
        filled, first, most = self.quarters[level][cell], self.first[level][cell], self.most[level + 1]
        lower = (rows[term] >> (self.height - 1 - level) & 1) * 2
        halves = []
        for side in (0, 1):
            quarter = lower + side
            kept = np.flatnonzero(filled >> quarter & 1)
            if len(kept):
                child = first[kept] + _ONES[filled[kept] & ((1 << quarter[kept]) - 1)]
                halves.append((node[kept] * 2 + side, term[kept], child))
        if not halves:
            return None
        node, term, cell = (np.concatenate(x) for x in zip(*halves))  # ranges of the lower half come first
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        bounds = np.add.reduceat(weights[term] * most[cell], start)
        count = np.diff(np.append(start, len(node)))
        kept = np.flatnonzero(bounds >= floor)
        if not len(kept):
            return None
        kept = kept[np.argsort(-bounds[kept], kind="stable")]
        _, at = ranges(start[kept], count[kept])
        which = node[start[kept]]
        return level + 1, bounds[kept], column[which // 2] * 2 + which % 2, np.concatenate([[0], np.cumsum(count[kept])]), term[at], cell[at]


def _grids(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Treaps of blocks, given N and L."""

    def build(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                term, doc, tf = (np.frombuffer(batch.column(c)[k].as_py(), np.int32).astype(np.int64) for c in ("term", "doc", "tf"))
                n = batch.column("n")[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:  # whole numbers of any size, where 64 bits would not hold the product
                    n = n.astype(object)
                m = (75 + 25 * n * n_docs // max(1, n_terms)).astype(np.int64)
                impact = 10**9 * tf // (1000 * tf + 12 * m[doc])
                terms = batch.column("terms")[k].values
                side, bits, drops = Treap.pack(len(terms), len(n), term, doc, impact)
                few = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([few.column("ids"), few.column("terms"), few.column("df"), pa.array([side], pa.int32()),
                                                  pa.array([bits], pa.list_(pa.binary())), pa.array([drops], pa.list_(pa.binary()))], ["ids", "terms", "df", "side", "bits", "drops"])

    return blocks.mapInArrow(build, f"ids {blocks.schema['ids'].dataType.simpleString()}, {INDEX}")


@dataclass(frozen=True)
class Index:
    """Blocks of grids, with the number of documents that hold a term (N) and of all their terms (L)."""

    blocks: DataFrame
    n_docs: int
    n_terms: int

    def frequencies(self) -> DataFrame:
        """``term`` and the number of documents that hold it."""
        each = self.blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x"))
        return each.groupBy(F.col("x.terms").alias("term")).agg(F.sum(F.col("x.df").cast("long")).alias("df"))


def build_index(docs: DataFrame, terms: pa.Array | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of all documents, with rows for ``terms``, or for all terms."""
    spark = docs.sparkSession
    shared = None if terms is None else spark.sparkContext.broadcast(terms.cast(pa.large_string()))
    blocks = stored(_postings(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shared), "postings")
    each = blocks.select(F.explode("n").alias("n")).filter("n > 0")
    n_docs, n_terms = each.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    return Index(stored(_grids(blocks, n_docs, n_terms), "grids"), n_docs, n_terms)


def search_index(index: Index, part: pa.Table, top: int = TOP) -> DataFrame:
    """``k`` (row of ``part``), ``doc_id`` and ``score``: each task's ``top`` documents of every item."""
    words, first = lower_words(*tb.utf8(part.column("text")))
    coded = words.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spark = index.blocks.sparkSession
    asked = spark.sparkContext.broadcast(names)

    def known(batches):  # frequencies of the items' terms only come to the driver
        for batch in batches:
            yield batch.filter(pc.is_in(batch.column("term").cast(pa.large_string()), asked.value))

    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * index.n_docs + 2)) / (F.lit(2.0) * F.col("df") + 1)))
    got = index.frequencies().mapInArrow(known, "term string, df long").select("term", weight.cast("long").alias("w")).toArrow()
    w = np.zeros(len(names), np.int64)
    place = pc.index_in(got.column("term").cast(pa.large_string()), names).to_numpy(zero_copy_only=False).astype(np.int64)
    w[place] = got.column("w").to_numpy()
    items = []
    for low, high in zip(first[:-1], first[1:]):
        term, count = np.unique(code[low:high], return_counts=True)
        items.append((term, count * w[term]))
    shared = spark.sparkContext.broadcast((names, items))
    schema = index.blocks.schema["ids"].dataType

    def answer(batches):
        names, items = shared.value
        best = [[] for _ in items]  # (-score, id is not null, id), in order
        kind = None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for b in range(batch.num_rows):
                ids = batch.column("ids")[b].values
                row = pc.fill_null(pc.index_in(names, batch.column("terms")[b].values.cast(pa.large_string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                treap = Treap.load(batch.column("side")[b].as_py(), batch.column("bits")[b].as_py(), batch.column("drops")[b].as_py())
                for k, (term, weights) in enumerate(items):
                    here = np.flatnonzero((row[term] >= 0) & (weights > 0))
                    if not len(here):
                        continue
                    floor = -best[k][-1][0] if len(best[k]) == top else 1
                    new = treap.search(row[term[here]], weights[here], floor, top)
                    if new:
                        found = ids.take(pa.array([c for _, c in new])).to_pylist()
                        best[k] = sorted(best[k] + [(-s, i is not None, i) for (s, _), i in zip(new, found)], key=lambda x: x if x[1] else (*x[:2], 0))[:top]
        if any(best):
            flat = [(k, i, -s) for k, rows in enumerate(best) for s, _, i in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.int64())], ["k", "doc_id", "score"])

    return index.blocks.select("ids", "terms", "side", "bits", "drops").mapInArrow(answer, f"k int, doc_id {schema.elementType.simpleString()}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``top`` best documents of every item."""
    spark, kind = docs.sparkSession, items.schema[item_col].dataType
    out = []
    for part in item_parts(items, item_col, item_text):
        terms = lower_words(*tb.utf8(part.column("text")))[0].unique()
        found = search_index(build_index(docs, terms, id_col, text_col), part, top)
        best = Window.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(pa.table({"k": pa.array(range(part.num_rows), pa.int32()), "item_id": part.column("item")})).withColumn("item_id", F.col("item_id").cast(kind))
        out.append(ranked.join(F.broadcast(names), "k").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
