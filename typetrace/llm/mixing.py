"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

Each source has a target in words; each of its documents starts with the copies
``target / source_size``: a whole part, and a fraction that must become 0 or 1. Fractions are rounded
in pairs: mass (fraction times size) moves from one document to the other, in a random direction whose
odds keep both expectations, until one of the two is whole. The other goes on to the next pair. The
words of a source are so kept exactly, but for the last document, which is rounded by its own odds: a
source misses its target by less than one document.

The pairs form a tree. A source's documents are dealt by hash into groups of about ``fan``; each
group is folded and leaves one document; those are dealt again, until a source has one left. No group
grows with the data, whatever the size of the source. All draws are hashes of ids and a seed, and
every group is folded in a fixed order, so a rerun agrees.

Defined results: a null text has size 0; null is a source of its own, the last; a document of size 0
takes 0 words; an empty table gives an empty result; a row repeated with its id gets the same number
of copies each time, and all its repeats count in size and target. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typetrace.llm.common import let, stored, word_count

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
FAN, SEED = 64, 20240607
WHOLE = 1e-9  # fractions nearer than this to 0 or 1 are whole


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source``, ``n``, ``source_size``, ``target`` from rows (``source``, ``size``).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all words;
    no target is above ``cap`` times its source's size, and what is over is shared anew by weight. In
    the order of cap per weight, the level that all uncapped sources reach is the largest of
    (words left after the caps before) / (weight left). The windows see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return (by_source.withColumn("rank", F.row_number().over(named))
            .withColumn("weight", F.element_at(turn, (F.col("rank") - 1) % len(weights) + 1))
            .withColumn("most", F.col("source_size") * F.lit(cap))
            .withColumn("ratio", F.col("most") / F.col("weight"))
            .withColumn("left", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", F.max(F.col("left") / F.col("weight_left")).over(everything))
            .select("source", "n", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target")))


def _draw(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def _with_fraction(unit: Column, p: Column) -> Column:
    return F.struct(*[unit[c].alias(c) for c in ("key", "doc_id", "source", "size", "times", "base")], p.alias("p"))


def _pair(a: Column, b: Column, seed: int) -> Column:
    """Both units after mass has moved between them: one of them is whole."""
    wa, wb = a["size"] * a["times"], b["size"] * b["times"]

    def settle(m: Column) -> Column:
        to_a = _draw(a["key"], b["key"], F.lit(seed)) * (m["up"] + m["down"]) < m["down"]
        moved = F.when(to_a, m["up"]).otherwise(-m["down"])
        pa, pb = a["p"] + moved / wa, b["p"] - moved / wb
        snap = lambda p: F.when(p < WHOLE, 0.0).when(p > 1 - WHOLE, 1.0).otherwise(p)
        return F.array(_with_fraction(a, snap(pa)), _with_fraction(b, snap(pb)))

    room = F.struct(F.least((1 - a["p"]) * wa, b["p"] * wb).alias("up"), F.least(a["p"] * wa, (1 - b["p"]) * wb).alias("down"))
    return let(room, settle)


def _fold(units: Column, kind: str, seed: int) -> Column:
    """Fold a group: ``done`` has the whole units, ``open`` at most one that is not."""
    whole = lambda u: (u["p"] == 0.0) | (u["p"] == 1.0)
    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(empty.alias("open"), empty.alias("done"))

    def add(acc: Column, unit: Column) -> Column:
        both = F.when(F.size(acc["open"]) == 0, F.array(unit)).otherwise(_pair(acc["open"][0], unit, seed))
        return let(both, lambda units: F.struct(
            F.filter(units, lambda u: ~whole(u)).alias("open"), F.concat(acc["done"], F.filter(units, whole)).alias("done")))

    return F.aggregate(units, start, add)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = SHARE, cap: float = CAP, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """Copies of every row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    units = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
                   .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "mix-units")
    targets = stored(source_targets(units.select("source", (F.col("size") * F.col("times")).alias("size")), weights, share, cap), "mix-targets")
    most = targets.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), fan)))

    same = F.col("u.source").eqNullSafe(F.col("t.source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    first = (units.alias("u").join(targets.alias("t"), same, "left")
             .select("u.*", "t.n", "t.source_size", "t.target", ratio.alias("ratio"))
             .withColumn("base", F.floor(F.col("ratio") + WHOLE).cast("int"))
             .withColumn("p", F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)))
             .withColumn("p", F.when((F.col("p") < WHOLE) | (F.col("size") == 0), 0.0).otherwise(F.col("p")))
             .withColumn("key", F.xxhash64("doc_id", "size", F.lit(seed)))
             .withColumn("groups", F.ceil(F.col("n") / F.lit(fan)).cast("long")))
    fields = ["key", "doc_id", "source", "size", "times", "base", "p"]
    kind = "struct<key:bigint,doc_id:bigint,source:string,size:bigint,times:bigint,base:int,p:double>"
    whole = [first.filter("p = 0").select(*fields)]
    todo = first.filter("p > 0").select(*fields, "groups")
    for level in range(levels):
        group = F.pmod(F.xxhash64("key", "doc_id", F.lit(level)), F.col("groups"))
        folded = stored(todo.groupBy("source", "groups", group.alias("group"))
                        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("units"))
                        .select("groups", _fold(F.col("units"), kind, seed + level).alias("f")), f"mix-level{level}")
        whole.append(folded.select(F.explode("f.done").alias("u")).select("u.*"))
        todo = (folded.select("groups", F.explode("f.open").alias("u"))
                .select("u.*", F.ceil(F.col("groups") / F.lit(fan)).cast("long").alias("groups")))
    last = _draw(F.col("key"), F.col("doc_id"), F.lit(seed + levels)) < F.col("p")
    whole.append(todo.select(*fields[:-1], F.when(last, 1.0).otherwise(0.0).alias("p")))
    rounded = reduce(DataFrame.unionAll, whole).withColumn("copies", F.col("base") + F.col("p").cast("int"))
    same = F.col("r.source").eqNullSafe(F.col("t.source"))
    return (rounded.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).alias("r")
            .join(targets.alias("t"), same, "left")
            .select("doc_id", "r.source", "size", "t.source_size", "t.target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with all its columns."""
    copies = mix_sources(docs, id_col, text_col, source_col, **options).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")).distinct()
    same = (docs[id_col].eqNullSafe(F.col("__id")) & docs[source_col].eqNullSafe(F.col("__source"))
            & (word_count(docs[text_col]) == F.col("__size")))
    return (docs.join(copies, same).withColumn("__n", F.explode(F.expr("array_repeat(1, __copies)"))).select(*[docs[c] for c in docs.columns]))
