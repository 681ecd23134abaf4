"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``SIZE`` bytes that covers it starts anywhere else too, in any document.

*Which strings can repeat.* Every string of ``SIZE`` bytes has an anchor: the least hash among its
``GRAM``-byte grams, the leftmost of equals. Equal strings have equal anchors, and neighbouring
strings mostly share theirs, so a document is a chain of anchors, each with the run of strings it stands
for. Only anchors whose gram occurs again go on; this is a count that combines before its shuffle, over one row
for about 80 bytes.

*Which strings do repeat.* Runs that are equal as a whole are folded into one with a count, and what all
of an anchor's runs agree in needs no sorting. The texts of the distinct other runs come together by
anchor, in blocks of many anchors, and are sorted in two stages: suffixes smaller than their
successor are sorted directly, by ``SIZE`` bytes; all others follow from scanning the buckets
of first bytes from the least on, since such a suffix stands in its bucket in the order of its
successors. Neighbours in that order with a common prefix of ``SIZE`` bytes are repeated strings.

An anchor with more than ``CROWD`` distinct runs (a passage in very many contexts) is not brought into one
block: its strings are counted by digest, each on its own, with the same result.

Defined results: a null text is empty; texts under ``SIZE`` bytes lose nothing; a row repeated with its
id repeats all its strings; rows that share an id are told apart by their text. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb
from typetrace.llm.common import stored

SIZE, GRAM, CROWD = 200, 32, 20_000
PIECE = 4 << 20  # bytes of one long text that are worked on at a time
BLOCK = 512 << 10  # bytes of run texts that are sorted together
_PLACE = np.uint64((1 << 24) - 1)
_WIDTH = 256  # a run's place is its first byte x 256 + its number of strings, at most SIZE - GRAM + 1


def runs_of(data: np.ndarray, off: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """Runs of strings by anchor: anchor hash, first start, last start, digest of the run."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < size:
        return empty.astype(tb.U64), empty, empty, empty.astype(tb.U64)
    hashes = tb.SpanHash(data)
    at = np.arange(n - gram + 1)
    grams = hashes(at, at + gram)
    least = (grams & ~_PLACE) | at.astype(tb.U64)
    width, span = size - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    anchor = (least & _PLACE).astype(np.int64)  # of the string at each start
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(off) >= size)
    inside[off[long]] += 1
    inside[off[long + 1] - size + 1] -= 1
    inside = np.cumsum(inside)[:len(anchor)] > 0
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    # Texts of exactly ``size`` bytes may follow each other without a gap.
    change[off[long]] = True
    first = np.flatnonzero(change[:-1] & inside)
    last = np.flatnonzero(change[1:] & inside)
    place = anchor[first]
    digest = tb.mix(hashes.raw(first, last + size) + (place - first).astype(tb.U64) * tb.U64(0xD6E8FEB86659FD93) + (last - first).astype(tb.U64) * tb.U64(0xA0761D6478BD642F))
    return grams[place], first, last, digest


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one counts so."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = 1
    turn = np.where(step != 0, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    return step[turn] > 0


def two_stage_order(text: np.ndarray, wanted: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Positions of the mask ``wanted``, ordered by the ``size`` bytes that follow each.

    ``text`` ends with ``size`` zero bytes that are not wanted. Positions with the same ``size`` bytes stand together.
    """
    small = smaller_than_next(text)
    raw = text.tobytes()
    # A larger suffix is induced from its successor, so runs of them are needed up to the next smaller one.
    follow = np.where(small, np.arange(len(text)), len(text) - 1)
    follow = np.minimum.accumulate(follow[::-1])[::-1]
    edge = np.zeros(len(text) + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(edge, at, 1)
    np.add.at(edge, follow[at] + 1, -1)
    needed = np.cumsum(edge)[:-1] > 0
    direct = np.flatnonzero(needed & small).tolist()
    keys = [raw[i:i + size] for i in direct]
    direct = np.array(direct, np.int64)[sorted(range(len(keys)), key=keys.__getitem__)]
    induce = needed & ~small
    head = text[direct]
    bounds = np.searchsorted(head, np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        front = fronts[c]
        wave = np.concatenate(front) if front else np.zeros(0, np.int64)
        front = [wave]
        while len(wave):  # equal bytes stay in the bucket
            wave = wave[wave > 0] - 1
            wave = wave[induce[wave] & (text[wave] == c)]
            front.append(wave)
        bucket = np.concatenate([*front, direct[bounds[c]:bounds[c + 1]]])
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induce[before]]
        before = before[text[before] > c]
        if len(before):
            by = np.argsort(text[before], kind="stable")
            before = before[by]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cuts):
                fronts[text[part[0]]].append(part)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated_starts(text: np.ndarray, wanted: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Mask of the wanted positions whose ``size`` bytes stand at another wanted position too."""
    order = two_stage_order(text, wanted, size)
    x, y = order[:-1], order[1:]
    words = np.zeros(len(text), np.uint64)  # eight bytes from each position
    for k in range(8):
        words[:len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    same = np.arange(len(x))
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        same = same[words[x[same] + k] == words[y[same] + k]]
    out = np.zeros(len(text), bool)
    out[x[same]] = True
    out[y[same]] = True
    return out


def _runs(documents: DataFrame) -> DataFrame:
    """``anchor``, ``doc``, ``place`` and ``run`` (digest) of every run of every text."""

    def find(batches):
        for rows, data, off in tb.slices(batches):
            docs = rows.column("doc").to_numpy()
            # One long text is cut into pieces that overlap, so that each string lies in one of them.
            cuts = [(0, len(data))] if len(data) <= PIECE else [(a, min(len(data), a + PIECE + SIZE - 1)) for a in range(0, len(data) - SIZE + 1, PIECE)]
            for a, b in cuts:
                where = off if len(cuts) == 1 else np.array([0, b - a])
                anchor, first, last, run = runs_of(data[a:b], where)
                text = np.searchsorted(where, first, "right") - 1
                place = (first - where[text] + a) * _WIDTH + last - first + 1
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(docs[text]), pa.array(place), pa.array(run.view(np.int64))],
                                                 ["anchor", "doc", "place", "run"])

    return documents.mapInArrow(find, "anchor long, doc long, place long, run long")


def _with_bytes(documents: DataFrame, carriers: DataFrame) -> DataFrame:
    """``carriers`` (``anchor``, ``run``, ``times``, ``doc``, ``place``) with the bytes of each run."""
    lists = carriers.groupBy("doc").agg(F.collect_list(F.struct("anchor", "run", "times", "place")).alias("runs"))

    def cut(batches):
        for rows, data, off in tb.slices(batches):
            runs = rows.column("runs")
            flat = runs.flatten()
            text = np.repeat(np.arange(rows.num_rows), np.diff(runs.offsets.to_numpy()))
            place = flat.field("place").to_numpy()
            start = place // _WIDTH + off[text]
            end = start + place % _WIDTH + SIZE - 1
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("run"), flat.field("times"), pa.array([raw[s:e] for s, e in zip(start.tolist(), end.tolist())], pa.binary())],
                                             ["anchor", "run", "times", "bytes"])

    return documents.join(lists, "doc").select("text", "runs").mapInArrow(cut, "anchor long, run long, times long, bytes binary")


def _mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1


def _sorted_blocks(texts: DataFrame) -> DataFrame:
    """Repeated strings of each run, as ranges (``low``, ``high``) of starts within it."""

    def sort_block(anchors: list, runs: list, times: list, parts: list):
        text = np.frombuffer(b"".join(parts) + bytes(SIZE + 8), np.uint8)
        size = np.array([len(p) for p in parts])
        base = np.cumsum(size) - size
        edge = np.zeros(len(text) + 1, np.int32)
        edge[base] += 1
        np.add.at(edge, base + size - SIZE + 1, -1)
        found = repeated_starts(text, np.cumsum(edge)[:-1] > 0)
        out = ([], [], [], [])
        for a, r, n, b, s in zip(anchors, runs, times, base, size):
            low, high = _mask_runs(np.ones(s - SIZE + 1, bool) if n > 1 else found[b:b + s - SIZE + 1])
            for column, value in zip(out, ([a] * len(low), [r] * len(low), low.tolist(), high.tolist())):
                column += value
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor", "run", "low", "high"])

    def sort(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and row[0] != held[0][-1]:
                    yield sort_block(*held)
                    held, size = ([], [], [], []), 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[3])
        if size:
            yield sort_block(*held)

    together = texts.repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(sort, "anchor long, run long, low long, high long")


def _counted_strings(texts: DataFrame) -> DataFrame:
    """The same for crowded anchors: strings are counted by digest, each on its own."""

    def spread(batches):
        for batch in batches:
            for a, r, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(raw, np.uint8)
                start = np.arange(len(data) - SIZE + 1)
                digest = tb.SpanHash(data)(start, start + SIZE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), v)) for v in (a, r, n)] + [pa.array(start), pa.array(digest.view(np.int64))],
                                                 ["anchor", "run", "times", "start", "digest"])

    strings = texts.mapInArrow(spread, "anchor long, run long, times long, start long, digest long")
    often = strings.groupBy("anchor", "digest").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor", "digest")
    return strings.join(often, ["anchor", "digest"]).select("anchor", "run", F.col("start").alias("low"), F.col("start").alias("high"))


def repeated_spans(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``doc``, ``low``, ``high``: byte ranges (end exclusive, overlapping) that repeated strings cover. ``documents``: ``doc``, ``text``."""
    runs = _runs(documents)
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("least"), F.max("run").alias("most")).filter("n > 1")
    hits = stored(runs.join(again.select("anchor", (F.col("least") == F.col("most")).alias("alike")), "anchor"), "runs")
    mixed = hits.filter(~F.col("alike"))
    # Of equal runs, one carries its bytes: the least place in the least document.
    folded = mixed.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("times"), F.min("doc").alias("doc"))
    carriers = mixed.join(folded, ["anchor", "run", "doc"]).groupBy("anchor", "run", "doc", "times").agg(F.min("place").alias("place"))
    texts = stored(_with_bytes(documents, carriers), "run-texts")
    crowded = stored(texts.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"), "crowded")
    if crowded.isEmpty():
        found = _sorted_blocks(texts)
    else:
        found = _sorted_blocks(texts.join(crowded, "anchor", "left_anti").select(*texts.columns)).unionByName(
            _counted_strings(texts.join(crowded, "anchor", "left_semi").select(*texts.columns)))
    begin = F.floor(F.col("place") / _WIDTH)
    whole = hits.filter("alike").select("doc", begin.alias("low"), (begin + F.col("place") % _WIDTH + (SIZE - 1)).alias("high"))
    parts = mixed.join(found, ["anchor", "run"]).select("doc", (begin + F.col("low")).alias("low"), (begin + F.col("high") + SIZE).alias("high"))
    return whole.union(parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the bytes left) of every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by_text = F.xxhash64("doc_id", "text")
    # An id stands for its row, unless ids repeat; then id and text together do.
    repeat = not texts.groupBy("doc_id").count().filter("count > 1").isEmpty()
    documents = texts.withColumn("doc", by_text if repeat else F.coalesce(F.col("doc_id").cast("long"), by_text))
    spans = repeated_spans(documents.select("doc", "text"), crowd).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for text, spans_ in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, kept, at, removed, n = text.encode(), [], 0, 0, 0
                end = -1
                for low, high in sorted((s["low"], s["high"]) for s in spans_ or ()):
                    if low > end:  # a new maximal run
                        kept.append(raw[at:low])
                        n += 1
                        removed += high - low
                        end = at = high
                    elif high > end:
                        removed += high - end
                        end = at = high
                kept.append(raw[at:])
                left = b"".join(kept)
                for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return documents.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
