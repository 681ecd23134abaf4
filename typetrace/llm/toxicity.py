"""Toxicity: a factorisation machine over hashed terms.

A text's terms are its words and their beginnings of 4, 5 and 6 bytes, lower-cased, hashed into a table of
2^``BITS`` slots and taken once each. The table has a linear weight and a factor vector a slot, in single precision,
whatever the texts. The machine adds to the linear weights the products of factor
vectors, so two terms together may weigh more, or less, than apart. How far a slot's weights may move
follows from its evidence: its log likelihood ratio against the label, full at ``G2``, and for the
factors also how evenly it parts the texts, as terms may tell only as a pair. No term is left out
for weak evidence. The machine is fitted on the driver, on a bounded sample of distinct labelled texts: about ``ROWS`` of
them, and about ``SAMPLE_BYTES`` of text; whole texts are taken, by a hash. The fitted table is broadcast.

Defined results: null counts as empty and gets the mean label as score, like any text without a
known term; labels that repeat or contradict each other count by their mean; without labels of both
kinds the score is the mean label (0.0 without any). Copies of a text count once in fitting. A repeated row gets the same
score. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb
from typetrace.llm.common import stored
from typetrace.llm.training import labelled_texts

ROWS, SAMPLE_BYTES, BITS, G2 = 10_000, 40 << 20, 18, 25.0
FACTORS, STEPS, EPOCHS, RATE, RIDGE = 8, 200, 10, 0.1, 2e-4
BLOCK_TERMS = 200_000
STEMS = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[[*b"abcdefghijklmnopqrstuvwxyz'", *range(0x80, 256)]] = True
_SLOT = np.uint64((1 << BITS) - 1)


def slots_of(data: np.ndarray, off: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot of a term) pairs of lower-cased texts, in order; of slots that are ``live``."""
    start, end, first = tb.spans(_LETTER[data], off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    hashes = tb.SpanHash(data)
    slots, texts = [hashes(start, end) & _SLOT], [text]
    for k, width in enumerate(STEMS):
        at = np.flatnonzero(end - start > width)
        slots.append(tb.mix(hashes(start[at], start[at] + width) + np.uint64(k + 1)) & _SLOT)
        texts.append(text[at])
    slot, text = np.concatenate(slots).astype(np.int64), np.concatenate(texts)
    if live is not None:
        kept = np.flatnonzero(live[slot])
        slot, text = slot[kept], text[kept]
    pair = tb.distinct(text << BITS | slot)
    return pair >> BITS, pair & int(_SLOT)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    live: np.ndarray  # slots with a weight

    @classmethod
    def flat(cls, level: float) -> Machine:
        """Every text scores ``level``."""
        level = min(max(level, 1e-9), 1 - 1e-9)
        return cls(float(np.log(level / (1 - level))), np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32), np.zeros(1 << BITS, bool))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        text, slot = slots_of(data, off, self.live)
        return 1 / (1 + np.exp(-np.clip(_energy(len(off) - 1, text, slot, self.bias, self.linear, self.factors)[0], -30, 30)))


def _energy(n, text, term, bias, linear, factors):
    """Machine's sum for each text, and the sums of factor vectors."""
    of = factors[term]
    sums = np.stack([np.bincount(text, weights=of[:, k], minlength=n) for k in range(factors.shape[1])], axis=1)
    squares = np.bincount(text, weights=(of**2).sum(axis=1), minlength=n)
    return bias + np.bincount(text, weights=linear[term], minlength=n) + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def fit_machine(ends: np.ndarray, slot: np.ndarray, y: np.ndarray, reach: tuple[np.ndarray, np.ndarray],
                factors: int = FACTORS, steps: int = STEPS, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> Machine:
    """Logistic loss by steps of adaptive size, from a fixed start. Text ``i`` has ``slot[ends[i]:ends[i + 1]]``;
    ``slot`` is worked on in place and of no use afterwards.

    ``reach`` scales each slot's steps, of its linear weight and of its factors. Texts are taken in
    blocks of about ``BLOCK_TERMS`` terms, a step each: at least ``epochs`` times all of them. A step moves the
    weights, and their running moments, of its block's slots in place.
    """
    n, m = len(y), len(reach[0])
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))  # stays: a text without a known term is as toxic as the labels on average
    live = np.maximum(*reach) > 0
    at = {"w": np.zeros(m, np.float32), "v": np.random.default_rng(5).standard_normal((m, factors), dtype=np.float32)}
    at["v"] *= 0.05
    scale = {"w": reach[0].astype(np.float32), "v": reach[1].astype(np.float32)[:, None]}
    first, second = ({k: np.zeros_like(v) for k, v in at.items()} for _ in range(2))
    cuts = tb.distinct(np.concatenate([np.searchsorted(ends, np.arange(0, len(slot), BLOCK_TERMS)), [0, n]]))
    blocks = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    steps, known = max(steps, epochs * len(blocks)), int(live.sum())
    place, own = np.zeros(m, np.int32), []
    for low, high in blocks:  # a block's own slots; its terms become places among them, where they are
        terms = slot[ends[low]:ends[high]]
        own.append(tb.distinct(terms))
        place[own[-1]] = np.arange(len(own[-1]))
        terms[:] = place[terms]
    for step in range(1, steps + 1):
        k = step % len(blocks)
        (low, high), here = blocks[k], own[k]
        terms, rows, want = slot[ends[low]:ends[high]], np.repeat(np.arange(high - low), np.diff(ends[low:high + 1])), y[low:high]
        mine = {k: v[here] for k, v in at.items()}
        by = {k: v[here] for k, v in scale.items()}
        w, v = by["w"] * mine["w"], by["v"] * mine["v"]
        energy, sums = _energy(len(want), rows, terms, bias, w, v)
        gap = (1 / (1 + np.exp(-np.clip(energy, -30, 30))) - want) / len(want)
        # A factor at a time, so a block's temporaries are a column each.
        each = gap[rows]
        pull = lambda k: each * (sums[rows, k] - v[terms, k])
        slope = {"w": np.bincount(terms, weights=each, minlength=len(here)),
                 "v": np.stack([np.bincount(terms, weights=pull(k), minlength=len(here)) for k in range(factors)], axis=1)}
        now = rate if len(blocks) == 1 else rate * (1 - 0.9 * step / steps)
        for k, g in slope.items():
            g = (by[k] * g + ridge * mine[k] / known).astype(np.float32)
            one, two = 0.9 * first[k][here] + 0.1 * g, 0.999 * second[k][here] + 0.001 * g * g
            first[k][here], second[k][here] = one, two
            at[k][here] = mine[k] - now * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    at["w"] *= scale["w"]
    at["v"] *= scale["v"]
    return Machine(bias, at["w"], at["v"], live)


def _counted(batches):
    """Texts with a term in it, and of those the label's sum, for every slot."""
    n, pos = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for rows, data, off in tb.slices(batches):
        text, slot = slots_of(data, off)
        n += np.bincount(slot, minlength=len(n))
        pos += np.bincount(slot, weights=rows.column("y").to_numpy(zero_copy_only=False)[text], minlength=len(n))
    used = np.flatnonzero(n)
    for at in range(0, len(used), 1 << 16):
        some = used[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(pos[some])], ["slot", "n", "pos"])


def evidence(sample: DataFrame, n: int, pos: float) -> tuple[np.ndarray, np.ndarray]:
    """How far each slot's linear weight and factors may move (0 to 1)."""
    counts = sample.mapInArrow(_counted, "slot int, n long, pos double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, b = F.col("pos"), F.col("n") - F.col("pos")
    rest = n - F.col("n")
    rate = pos / n
    g2 = 2 * (part(a, F.col("n") * rate) + part(b, F.col("n") * (1 - rate)) + part(pos - a, rest * rate) + part(n - pos - b, rest * (1 - rate)))
    got = counts.select("slot", (F.col("n") / n).alias("share"), F.round(g2, 6).alias("g2")).toArrow()  # at most a row a slot
    slot = got.column("slot").to_numpy()
    tied, evenly = (np.zeros(1 << BITS, np.float32) for _ in range(2))
    tied[slot] = np.clip(got.column("g2").to_numpy() / G2, 0, 1) ** 2
    share = got.column("share").to_numpy()
    evenly[slot] = (4 * share * (1 - share)) ** 2
    return tied, np.maximum(tied, evenly)


def _listed(batches):
    """Label, a hash and the slots of every text."""
    for rows, data, off in tb.slices(batches):
        text, slot = slots_of(data, off)
        ends = np.searchsorted(text, np.arange(len(off)))
        key = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(slot.astype(np.uint64) + np.uint64(1)))])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slot.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column("y"), pa.array((key[ends[1:]] - key[ends[:-1]]).astype(np.int64)), lists], ["y", "key", "slots"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn=None, rows: int = ROWS, size: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    lower = docs.select(F.col(id_col), F.lower(text_col).alias("text"))
    sample = stored(labelled_texts(lower, labels, "toxic", rows, learn, id_col, "text"), "toxic-sample")
    # Long texts: fewer of them, as many as the bytes allow.
    share = min(1.0, size / max(1, sample.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0))
    sample = sample.filter(F.pmod(F.xxhash64("text", F.lit(12)), F.lit(1 << 30)) < int(share * (1 << 30)))
    n, pos = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not 0 < pos < n:
        return Machine.flat(pos / n if n else 0.0)
    reach = evidence(sample, n, float(pos))
    got = sample.mapInArrow(_listed, "y double, key long, slots array<int>").toArrow()
    y, key = got.column("y").to_numpy(), got.column("key").to_numpy()
    chunks = got.column("slots").chunks
    del got
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(x.offsets.to_numpy()) for x in chunks)]).astype(np.int64)
    # Mixed by a hash of the terms: the same rows in the same order on every run, whatever tasks they came from.
    order = np.lexsort((y, size, key))
    ends = np.concatenate([[0], np.cumsum(size[order])])
    to = np.empty(len(y), np.int64)
    to[order] = ends[:-1]
    # Moved chunk by chunk, each freed as it is done, so the terms are held about once.
    slot, row = np.empty(ends[-1], np.int32), 0
    chunks.reverse()
    while chunks:
        part = chunks.pop()
        at = part.offsets.to_numpy().astype(np.int64)
        width = np.diff(at)
        slot[np.repeat(to[row:row + len(part)] - at[:-1] + at[0], width) + np.arange(at[-1] - at[0])] = part.flatten().to_numpy()
        row += len(part)
    pa.default_memory_pool().release_unused()
    return fit_machine(ends, slot, y[order], reach)


def score_toxicity(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for rows, data, off in tb.slices(batches):
            score = shared.value.score(data, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    return texts.mapInArrow(judge, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Machine, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score under ``cut``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for rows, data, off in tb.slices(batches, "__lower"):
            yield rows.drop_columns(["__lower"]).filter(pa.array(shared.value.score(data, off) < cut))

    return docs.withColumn("__lower", F.lower(text_col)).mapInArrow(keep, docs.schema)
