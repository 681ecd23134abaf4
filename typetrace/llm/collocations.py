"""Phrase collocations by HAT-trie counting.

A text is lower-cased (A to Z) and split at sentence marks and line ends into pieces, and those into words.
Tasks number the words of their languages and count all phrases of one to three words in a trie over word ids. Its
leaves are hash containers. A container serves a range of ids at first; beyond ``BURST`` phrases it bursts: a range
is halved at its middle phrase's id, and a container of a single id becomes a node of the trie with one container for the
next word. When a task holds ``HELD`` phrases (or ``NAMED`` words), whole subtrees are spilled, the largest first,
as sorted runs. Runs are cut by prefix: the first two words, and one of ``SLICES`` slices of the third, so that a very common
beginning is not one partition. A run's piece travels compressed; pieces are merged per prefix partition, ``CUTS`` for each
of the session's shuffle partitions.

The rest are joins of counts of at least ``LEAST``: every part of a phrase occurs as often as the phrase at
least, so no part is missing. Scores are whole-number arithmetic in 38 decimal digits, exact up to 10**16 words.

Defined results: null and empty texts have no words; a null language is ``und``, and so is the language ``und``;
repeated rows count each; ties go by descending count, then by the phrase's bytes. Other columns are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb
from typetrace.llm.common import stored
from typetrace.llm.tokens import LOWER, spelled

LEAST, COVERED, TOP, SCALE = 10, 50, 2000, 1_000_000
BURST, HELD, NAMED = 1 << 15, 2_000_000, 500_000  # phrases of a container and of a task, words of a task
BLOCK = 1 << 20  # words counted at a time
CUTS, SLICES = 8, 256  # prefix partitions for each shuffle partition, slices of a third word
PIECES = 256  # pieces sent at a time
PARTS = 32  # parts of a language ranked by themselves first
ID_BITS = 21  # three word ids fill one 64-bit phrase; 0 stands for no word
_ID = (1 << ID_BITS) - 1
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK = _CUT.copy()
_BREAK[[0x20, 0x09]] = True
WORDS = 3
RUN = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("phrases", pa.binary()), ("counts", pa.binary())])


class Container:
    """A hash table from phrases to counts, by open addressing over NumPy arrays."""

    def __init__(self, size: int = 64):
        self.phrase = np.zeros(size, np.int64)  # 0: free, no phrase is 0
        self.count = np.zeros(size, np.int64)
        self.used = 0

    def add(self, phrase: np.ndarray, count: np.ndarray) -> None:
        """Distinct phrases and what to add to their counts."""
        need = 2 * (self.used + len(phrase))
        if need > len(self.phrase):
            old = self.items()
            size = 1 << (need - 1).bit_length()
            self.phrase, self.count, self.used = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
            self._put(*old)
        self._put(phrase, count)

    def _put(self, phrase: np.ndarray, count: np.ndarray) -> None:
        mask = len(self.phrase) - 1
        slot = (tb.mix(phrase.view(np.uint64)) & np.uint64(mask)).astype(np.int64)
        while len(phrase):
            free = self.phrase[slot] == 0
            self.phrase[slot[free]] = phrase[free]  # of several for one slot, one stays
            mine = self.phrase[slot] == phrase
            self.used += int((free & mine).sum())
            self.count[slot[mine]] += count[mine]
            phrase, count, slot = phrase[~mine], count[~mine], (slot[~mine] + 1) & mask

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.phrase)
        return self.phrase[at], self.count[at]


class Node:
    """Trie node over ids of the word at ``depth``: child k serves phrases from ``low[k]`` to the next bound."""

    def __init__(self, depth: int, low: int, high: int):
        self.depth, self.high = depth, high
        self.low = [low]
        self.children: list[Container | Node] = [Container()]

    def add(self, phrase: np.ndarray, count: np.ndarray) -> int:
        """Add sorted distinct phrases; how many are new."""
        cut = np.append(np.searchsorted(phrase, self.low), len(phrase))
        new = 0
        for k in np.flatnonzero(np.diff(cut))[::-1].tolist():  # from the right, as bursts move what is behind
            part, n, child = phrase[cut[k]:cut[k + 1]], count[cut[k]:cut[k + 1]], self.children[k]
            if isinstance(child, Node):
                new += child.add(part, n)
                continue
            before = child.used
            child.add(part, n)
            new += child.used - before
            if child.used > BURST:
                self.burst(k)
        return new

    def burst(self, k: int) -> None:
        phrase, count = self.children[k].items()
        order = np.argsort(phrase)
        phrase, count = phrase[order], count[order]
        step = 1 << ID_BITS * (WORDS - 1 - self.depth)
        low, high = self.low[k], self.low[k + 1] if k + 1 < len(self.low) else self.high
        if high - low <= step:  # one id: a node over the next word; phrases of equal words are one, so the last word never bursts
            below = Node(self.depth + 1, low, high)
            below.add(phrase, count)
            self.children[k] = below
            return
        middle = int(phrase[len(phrase) // 2]) // step * step
        if middle <= low:
            middle += step
        at = int(np.searchsorted(phrase, middle))
        halves = [Container(), Container()]
        halves[0].add(phrase[:at], count[:at])
        halves[1].add(phrase[at:], count[at:])
        self.children[k:k + 1] = halves
        self.low[k:k + 1] = [low, middle]

    def size(self) -> int:
        return sum(c.size() if isinstance(c, Node) else c.used for c in self.children)

    def runs(self):
        """Phrases and counts in order, container by container."""
        for child in self.children:
            if isinstance(child, Node):
                yield from child.runs()
            elif child.used:
                phrase, count = child.items()
                order = np.argsort(phrase)
                yield phrase[order], count[order]

    def spill(self, aim: int):
        """Runs of the largest subtrees, until ``aim`` phrases are given out; each subtree starts anew."""
        sizes = [c.size() if isinstance(c, Node) else c.used for c in self.children]
        for k in np.argsort(sizes)[::-1].tolist():
            if aim <= 0 or not sizes[k]:
                return
            child, self.children[k] = self.children[k], Container()
            aim -= sizes[k]
            if isinstance(child, Node):
                yield from child.runs()
            else:
                phrase, count = child.items()
                order = np.argsort(phrase)
                yield phrase[order], count[order]


def phrases_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts, the text of each, and for each how many words (itself included) follow in its piece, 3 at most."""
    data = LOWER[data]
    inside = ~_BREAK[data]
    start, end, first = tb.spans(inside, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
    joined = np.zeros(len(start) + 1, bool)  # to the word before
    if len(start) > 1:
        joined[1:-1] = (text[1:] == text[:-1]) & (cuts[start[1:]] == cuts[end[:-1]])
    reach = 1 + joined[1:].astype(np.int64)
    reach[:-1] += joined[1:-1] & joined[2:]
    return spelled(data, inside, start, end), text, reach


class Counter:
    """Trie of a task with its word ids, one for each (language, word)."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.ids: dict[tuple[str, str], int] = {}
        self.root = Node(0, 0, 1 << ID_BITS * WORDS)
        self.held = 0
        self.words: dict[str, int] = {}

    def add(self, data: np.ndarray, off: np.ndarray, lang: pa.Array):
        """Count the texts; yields runs that had to leave."""
        words, text, reach = phrases_of(data, off)
        langs = lang.dictionary_encode()
        tongue = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        for at in range(0, len(words), BLOCK):  # a block's last phrases reach into the next
            stop = at + BLOCK + WORDS - 1
            yield from self.count(words[at:stop], tongue[at:stop], langs.dictionary.to_pylist(), reach[at:at + BLOCK])

    def count(self, words: pa.Array, tongue: np.ndarray, tongues: list[str], reach: np.ndarray):
        coded, own = words.dictionary_encode(), len(reach)
        width = len(coded.dictionary)
        pair, place = np.unique(tongue * width + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        if self.ids and len(self.ids) + len(pair) > NAMED:
            yield from self.close()
        for name, n in zip(tongues, np.bincount(tongue[:own], minlength=len(tongues)).tolist()):
            self.words[name] = self.words.get(name, 0) + n
        ids = self.ids
        names = coded.dictionary.take(pa.array(pair % width)).to_pylist()
        word = np.array([ids.setdefault((tongues[g], w), len(ids) + 1) for g, w in zip((pair // width).tolist(), names)], np.int64)[place]
        word = np.concatenate([word, np.zeros(own + WORDS - 1 - len(word), np.int64)])
        one = word[:own] << 2 * ID_BITS
        two = one + (word[1:own + 1] << ID_BITS)
        three = two + word[2:own + 2]
        phrase, count = np.unique(np.concatenate([one, two[reach >= 2], three[reach >= 3]]), return_counts=True)
        self.held += self.root.add(phrase, count)
        if self.held > HELD:
            runs = list(self.root.spill(self.held // 2))
            self.held -= sum(len(p) for p, _ in runs)
            yield from self.pieces(runs)

    def close(self):
        """All that is left, and the words of each language (under buckets below 0)."""
        yield from self.pieces(list(self.root.runs()))
        rows = [(-1 - crc32(f"{n} {g}".encode()) % CUTS, g, 0, n, None, None) for g, n in self.words.items() if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RUN)], schema=RUN)
        self.__init__(self.buckets)

    def pieces(self, runs):
        """Runs as one, in the order of the words' bytes, cut by language and prefix."""
        if not runs:
            return
        phrase, count = (np.concatenate(x) for x in zip(*runs))
        tongues = sorted({g for g, _ in self.ids})
        place = {g: k for k, g in enumerate(tongues)}
        tongue = np.array([place[g] for g, _ in self.ids], np.int64)
        spelling = pa.array([w for _, w in self.ids], pa.large_string())
        order = pc.array_sort_indices(spelling).to_numpy().astype(np.int64)
        rank = np.empty(len(order) + 1, np.int64)
        rank[0], rank[order + 1] = 0, np.arange(1, len(order) + 1)
        spelling, tongue = spelling.take(pa.array(order)), tongue[order]
        hashes = np.concatenate([[0], np.array([crc32(w.encode()) for w in spelling.to_pylist()], np.int64)]).astype(np.uint64)
        ids = [rank[phrase >> ID_BITS * (WORDS - 1 - k) & _ID] for k in range(WORDS)]
        prefix = tb.mix(hashes[ids[0]] << np.uint64(32) | hashes[ids[1]]) + (hashes[ids[2]] % np.uint64(SLICES))
        key = tongue[ids[0] - 1] * self.buckets + (tb.mix(prefix) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort((ids[0] << 2 * ID_BITS) + (ids[1] << ID_BITS) + ids[2])
        order = order[np.argsort(key[order].astype(np.uint16) if key.max() < 1 << 16 else key[order], kind="stable")]
        key, count = key[order], count[order]
        named = pa.concat_arrays([pa.array([None], pa.large_string()), spelling])
        start = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)).tolist()
        rows, string = [], lambda x: pa.scalar(x, pa.large_string())
        for block in range(0, len(start) - 1, PIECES):
            ends = start[block:block + PIECES + 1]
            text = pc.binary_join_element_wise(*(named.take(pa.array(i[order[ends[0]:ends[-1]]])) for i in ids), string(" "), null_handling="skip")
            lines = pc.binary_join_element_wise(text, string(""), string("\n"))
            at, data = np.frombuffer(lines.buffers()[1], np.int64), lines.buffers()[2]
            for low, high in zip(ends[:-1], ends[1:]):
                some = data[int(at[low - ends[0]]):int(at[high - ends[0]])]
                rows.append((int(key[low]) % self.buckets, tongues[int(key[low]) // self.buckets], len(some), high - low,
                             pa.compress(some, "zstd", asbytes=True), pa.compress(count[low:high].tobytes(), "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RUN)], schema=RUN)
            rows = []


def merged(pieces: pa.Table, least: int) -> pa.Table:
    """``lang``, ``phrase`` and ``n`` of a prefix partition's phrases of at least ``least`` occurrences; a null phrase: all words."""
    lang, size, n = (pieces.column(c).to_pylist() for c in ("lang", "size", "n"))
    if pieces.column("bucket")[0].as_py() < 0:
        return pa.table({"lang": lang[:1], "phrase": pa.nulls(1, pa.string()), "n": pa.array([sum(n)])})
    lines = b"".join(pa.decompress(x, s, "zstd", asbytes=True) for x, s in zip(pieces.column("phrases").to_pylist(), size))
    count = np.concatenate([np.frombuffer(pa.decompress(x, 8 * k, "zstd", asbytes=True), np.int64) for x, k in zip(pieces.column("counts").to_pylist(), n)])
    data = np.frombuffer(lines, np.uint8)
    start, end, _ = tb.spans(data != 10, np.array([0, len(data)]))
    coded = spelled(data, data != 10, start, end).dictionary_encode()
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, coded.indices.to_numpy(zero_copy_only=False), count)
    kept = np.flatnonzero(total >= least)
    return pa.table({"lang": pa.array(lang[:1] * len(kept), pa.string()), "phrase": coded.dictionary.take(pa.array(kept)).cast(pa.string()), "n": total[kept]})


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``phrase``, its words ``w1``, ``w2``, ``w3`` (null beyond it) and ``n`` of phrases of at least ``least`` occurrences; a null phrase: all words."""

    buckets = CUTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        counter = Counter(buckets)
        for rows, data, off in tb.slices(batches):
            yield from counter.add(data, off, rows.column("lang"))
        yield from counter.close()

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    runs = texts.mapInArrow(count, "bucket int, lang string, size long, n long, phrases binary, counts binary")
    found = runs.repartition("bucket").groupBy("bucket", "lang").applyInArrow(lambda pieces: merged(pieces, least), "lang string, phrase string, n long")
    word = F.split("phrase", " ")
    return found.select("lang", "phrase", *(F.get(word, F.lit(k)).alias(f"w{k + 1}") for k in range(WORDS)), "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * whole(a) * whole(a), whole(left) * whole(right))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's first ``top`` phrases."""
    counts = stored(phrase_counts(docs, least, lang_col, text_col), "phrases")
    n = counts.filter("phrase is null").groupBy("lang").agg(F.sum("n").alias("words"))
    one = counts.filter("w2 is null and w1 is not null").select("lang", F.col("phrase").alias("u"), F.col("n").alias("f"))
    two = counts.filter("w3 is null and w2 is not null").select("lang", "phrase", "w1", "w2", F.col("n").alias("a"))
    three = counts.filter("w3 is not null").select("lang", "phrase", "w1", "w2", "w3", F.col("n").alias("a"))

    def single(word: str, name: str) -> DataFrame:
        return one.select("lang", F.col("u").alias(word), F.col("f").alias(name))

    # Every two-word phrase with its parts and, of the longer ones around it, the largest count.
    long = three.select("lang", "w1", "w2", "a").union(three.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    pairs = two.join(single("w1", "l"), ["lang", "w1"]).join(single("w2", "r"), ["lang", "w2"]).join(long, ["lang", "w1", "w2"], "left").select(
        "lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
        (F.coalesce("longer", F.lit(0)) * 100 >= F.col("a") * covered).alias("inside"))
    # A cut after one word, and one after two.
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
    head = two.select("lang", "w1", "w2", F.col("a").alias("l2"))
    cuts = (three.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]).join(single("w1", "l1"), ["lang", "w1"]).join(single("w3", "r2"), ["lang", "w3"])
            .withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2"))))
    after = F.col("s2") < F.col("s1")
    triples = cuts.select("lang", "phrase", "a", F.when(after, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                          F.when(after, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"), F.lit(False).alias("inside"))
    # First within hashed parts of a language, so a language's last task reads PARTS x top rows at most.
    best = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    dealt = pairs.filter("not inside").union(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    ranked = dealt.withColumn("rank", best("part")).filter(F.col("rank") <= top).withColumn("rank", best()).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
