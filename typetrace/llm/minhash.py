"""Near-duplicates by MinHash with sequential Bayesian verification.

A document is the set of its word shingles. Documents of equal sets are one node, so copies cost
nothing further on. Every node has a MinHash signature of ``BANDS`` x ``ROWS`` values; nodes that agree
in all values of a band share a bucket. Candidates from buckets are compared batch by batch of their signatures: after n
values with m matches, the posterior of the similarity (uniform prior) gives the chance that it reaches the
threshold, and a pair falls out as soon as that is under ``MISS``. The survivors are compared exactly on
their full sets.

A bucket of n nodes is not spread into pairs. First every node meets one hub, the least node of its buckets;
then the hubs of those buckets that still hold several components. Buckets with common members are one family; what then
still is apart in a family is held, block by block, against all its members, by signature and then by
full sets, which are in the block. Members whose components have met are not compared again, and a block gives out one verified
link for each two components that meet, never its likely or its rejected pairs. No pair of different
components in a bucket goes untested. With 40 bands of 6, two
documents of similarity 0.8 share no bucket with a chance of 5e-6; that and ``MISS`` are all that
can be lost.

Defined results: null, empty and word-free texts have an empty set and no links; fewer words than a
shingle's are one shingle; a row repeated with its id gets the same result; texts that share
an id count as linked; a null id links nothing and has no component. Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typetrace.llm import textbytes as tb
from typetrace.llm.common import release, stored
from typetrace.llm.graph import components
from typetrace.llm.tokens import ranges

BANDS, ROWS, BATCH, MISS, SEED = 40, 6, 40, 1e-6, 99
SHINGLE, SIMILAR = 5, 80  # words, per cent
MEMBERS, MEMBER_SHINGLES = 2048, 1 << 21  # nodes, and shingles of nodes, on a side of a block
SALTS = 16  # parts that a bucket's rows are dealt into where they meet its facts
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. ASCII capitals are lowered."""
    data = _LOWER[data]
    start, end, first = tb.words(data, off)
    word = tb.SpanHash(data)(start, end)
    hashes, at = tb.windows_of(word, first, width)
    place = np.searchsorted(at, first)
    out = []
    for k in range(len(off) - 1):
        n = first[k + 1] - first[k]
        if n >= width:
            out.append(tb.distinct(hashes[place[k]:place[k + 1]]))
        elif n:
            whole = np.uint64(n)
            for w in word[first[k]:first[k + 1]]:
                whole = tb.mix(np.array([whole ^ w], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache
def _lines(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(seed)
    return rnd.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1), rnd.integers(0, 1 << 32, size, dtype=np.uint32)


def signature(shingles: np.ndarray, size: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """Least values of the set under ``size`` hash functions; the set must not be empty."""
    a, b = _lines(size, seed)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, (a[:, None] * x[None, k:k + 2048] + b[:, None]).min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket of each band."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


@lru_cache
def least_matches(size: int, similar: int, batch: int = BATCH, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(values compared, least matches that keep a pair) after each batch.

    Under a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1), and the chance that it is
    at least t is the binomial tail sum over j <= m of C(n + 1, j) t^j (1 - t)^(n + 1 - j).
    """
    t, out = similar / 100, []
    for n in range(batch, size + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n``, digest (``d1``, ``d2``) and ``bands`` of every document."""

    def sketch(batches):
        for rows, data, off in tb.slices(batches):
            sets = shingle_sets(data, off, width)
            filled = [k for k, s in enumerate(sets) if len(s)]
            keys = np.concatenate([*[band_keys(signature(sets[k])) for k in filled], np.zeros(0, np.int64)])
            count = np.array([len(s) for s in sets], np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))]).astype(np.int32)
            # Two sums over the mixed members: an order-free digest of 128 bits.
            d1, d2 = (np.array([tb.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (1, 2))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(count), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                                             ["doc_id", "n", "d1", "d2", "bands"])

    return texts.mapInArrow(sketch, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """``node``, signature and full set of documents, as bytes."""

    def full(batches):
        for rows, data, off in tb.slices(batches):
            sets = shingle_sets(data, off, width)
            filled = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(filled, pa.int64())), pa.array([signature(sets[k]).tobytes() for k in filled], pa.binary()),
                 pa.array([sets[k].tobytes() for k in filled], pa.binary())], ["node", "sig", "set"])

    return texts.mapInArrow(full, "node long, sig binary, set binary")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets reach the threshold; ``sets`` has ``node``, ``sig``, ``set``."""

    def with_both(df: DataFrame, column: str) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col(column).alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col(column).alias("y"))
        return df.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def likely(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in "xy")
            left, matches, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in least_matches(x.shape[1], similar):
                matches[left] += (x[left, at:n] == y[left, at:n]).sum(axis=1)
                left, at = left[matches[left] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(left))

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= similar * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = with_both(pairs, "sig").mapInArrow(likely, "a long, b long")
    return with_both(left, "set").mapInArrow(exact, "a long, b long")


class Merging:
    """Labels of a block's nodes, and which of them have met."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.names, both = np.unique(np.concatenate([left, right]), return_inverse=True)
        self.left, self.right = both[:len(left)], both[len(left):]

    def meet(self, a: int, b: int) -> None:
        for side in (self.left, self.right):
            side[side == b] = a


def _links(left: pd.DataFrame, right: pd.DataFrame, similar: int) -> tuple[list[int], list[int]]:
    """Links between nodes of different labels, one for each two labels that meet."""
    a, b = [], []
    x, y = (np.frombuffer(b"".join(d["sig"]), np.uint32).reshape(len(d), -1) for d in (left, right))
    sets = [np.frombuffer(s, np.uint64) for s in right["set"]]
    size = np.array([len(s) for s in sets])
    # Which members hold a shingle: owners[first[k]:first[k + 1]] for shingle k.
    shingles = np.concatenate(sets)
    order = np.argsort(shingles)
    owners, shingles = np.repeat(np.arange(len(sets)), size)[order], shingles[order]
    first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
    shingles, first = shingles[first], np.append(first, len(owners))
    node, labels = right["node"].to_numpy(), Merging(left["label"].to_numpy(), right["label"].to_numpy())
    for row, (mine, mine_set, sig) in enumerate(zip(left["node"].tolist(), left["set"], x)):
        own = np.frombuffer(mine_set, np.uint64)
        alive = np.flatnonzero((labels.right != labels.left[row]) & (np.minimum(size, len(own)) * 100 >= np.maximum(size, len(own)) * similar))
        matches, at = np.zeros(len(alive), np.int64), 0
        for n, least in least_matches(x.shape[1], similar):
            matches += (y[alive, at:n] == sig[at:n]).sum(axis=1)
            keep = matches >= least
            alive, matches, at = alive[keep], matches[keep], n
        if not len(alive):
            continue
        place = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
        place = place[shingles[place] == own]
        _, at = ranges(first[place], first[place + 1] - first[place])
        both = np.bincount(owners[at], minlength=len(sets))[alive]
        for other in alive[100 * both >= similar * (len(own) + size[alive] - both)].tolist():
            if labels.right[other] != labels.left[row]:
                labels.meet(labels.left[row], labels.right[other])
                a.append(min(mine, int(node[other])))
                b.append(max(mine, int(node[other])))
    return a, b


def links_in_blocks(mixed: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Verified links (``a``, ``b``) that join the components within families of buckets (``hub``, ``node``, ``n``, ``label``).

    Buckets with common members are one family. All its nodes that are not in its largest component are held against all
    its nodes, in blocks of bounded size. Families of one block share tasks' groups, about a quarter of a block in each.
    """
    # A node's hubs meet at its least one: few links, as many nodes have the same hubs.
    least = mixed.groupBy("node").agg(F.min("hub").alias("least"))
    meets = mixed.join(least, "node").select("hub", "least").distinct().union(least)
    family = components(meets.toDF("a", "b")).withColumnRenamed("label", "family")
    rows = stored(mixed.select("node", "n", "label").distinct().join(family, "node"), "families")
    counts = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    parts = lambda nodes, shingles: F.greatest(F.ceil(nodes / MEMBERS), F.ceil(shingles / MEMBER_SHINGLES)).cast("int")
    per_family = counts.groupBy("family").agg(F.sum("nodes").alias("nodes"), F.sum("shingles").alias("shingles"), F.max(F.struct("nodes", "shingles", "label")).alias("top")).select(
        "family", "nodes", "shingles", F.col("top.label").alias("main"), parts(F.col("nodes") - F.col("top.nodes"), F.col("shingles") - F.col("top.shingles")).alias("q_parts"),
        parts(F.col("nodes"), F.col("shingles")).alias("r_parts"), (parts(F.col("nodes"), F.col("shingles")) == 1).alias("alone"))
    per_family = stored(per_family.filter("q_parts > 0"), "family-sizes")
    packs = per_family.filter("alone").select(F.coalesce(4 * parts(F.sum("nodes"), F.sum("shingles")), F.lit(1))).first()[0]
    per_family = per_family.withColumn("pack", F.when(F.col("alone"), F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.col("family"))).drop("nodes", "shingles")
    known = rows.join(per_family, "family").join(sets.select("node", "sig", "set"), "node")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, columns = ["alone", "pack", "q", "r"], ["family", "node", "label", "sig", "set"]
    apart = known.filter(F.col("label") != F.col("main")).withColumn("q", part("q_parts")).withColumn("r", every("r_parts")).select(*keys, *columns)
    others = known.withColumn("r", part("r_parts")).withColumn("q", every("q_parts")).select(*keys, *columns)
    apart, others = apart.toDF(*keys, *columns), others.toDF(*keys, *columns)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, among = [], [], right.groupby("family").indices
        for name, at in left.groupby("family").indices.items():
            if name in among:
                x, y = _links(left.iloc[at], right.iloc[among[name]], similar)
                a += x
                b += y
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return apart.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least id reachable over links) and ``kept`` of every row."""
    texts = _documents(docs, id_col, text_col)
    sketches = stored(_sketches(texts, width), "sketches")
    linkable = sketches.filter("n > 0 and doc_id is not null")
    groups = linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    members = stored(linkable.join(groups, ["d1", "d2"]).select("doc_id", "node", "n", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")), "members")

    # Buckets with company, and the least node of each.
    in_bucket = members.filter("bands is not null").select("node", "n", F.explode("bands").alias("key")).distinct()
    hubs = in_bucket.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub < far").select("key", "hub")
    crowded = stored(in_bucket.join(hubs, "key"), "buckets")
    nodes = crowded.select("node").distinct()
    sets = stored(_full_sets(texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").distinct(), width), "sets")

    labels = stored(nodes.select("node", F.col("node").alias("label")), "node-labels")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after ``links`` between nodes have joined their components."""
        a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        found = components(links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        new = found.select(F.col("node").alias("label"), F.col("label").alias("new"))
        return stored(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "node-labels")

    # One hub for each node.
    first = crowded.filter("hub < node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    labels = merged(labels, similar_pairs(first, sets, similar))

    def mixed_buckets() -> DataFrame:
        """Rows of buckets that hold several components, with their labels."""
        here = crowded.join(labels, "node")
        mixed = here.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        # Every bucket's fact once for each part of its rows, so a large bucket's rows go to many tasks.
        facts = mixed.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return stored(here.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(facts, ["key", "salt"]).drop("salt"), "mixed")

    # All hubs of the buckets that are still mixed.
    release(docs.sparkSession)
    mixed = mixed_buckets()
    own = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    second = (mixed.filter("hub < node").select("hub", "node", "label").distinct().join(own, "hub").filter("label <> hub_label")
              .select(F.col("hub").alias("a"), F.col("node").alias("b")).join(first, ["a", "b"], "left_anti"))
    labels = merged(labels, similar_pairs(second, sets, similar))

    # What is still apart within a bucket: members of different components.
    release(docs.sparkSession)
    labels = merged(labels, links_in_blocks(mixed_buckets().select("hub", "node", "n", "label"), sets, similar))

    found = members.select("doc_id", "node").distinct().join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component"))
    # Several texts under one id are one document and link what they belong to.
    if not members.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").isEmpty():
        joined = components(members.select("doc_id", "node").join(labels, "node", "left").select(F.col("doc_id").alias("a"), F.coalesce("label", "node").alias("b")))
        found = joined.select(F.col("node").alias("doc_id"), F.col("label").alias("component"))
    return (sketches.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
            .withColumn("component_id", F.when((F.col("n_shingles") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the least of its component, with all their columns."""
    out = near_duplicates(docs, width, similar, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(out, docs[id_col] == F.col("__gone"), "left_anti")
