"""Text lines to character segments over column tables ``(line_id, x, y0, y1)``.

A column table holds one row per inked column with the extent of its ink. Segments are
half-open ``[x0, x1)`` with inclusive ``y0, y1``.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

MIN_RUN = 5          # a closed run needs this many columns
NARROW = 0.35        # share of the median width a segment has to exceed
FRAGMENT = 0.5       # a piece narrower than this share of its height is part of a character
WIDE = 1.35          # a piece wider than this multiple of its height is several characters
CHUNK = 512          # columns of a line packed into one value, at most
UNPACKED = 1 << 20   # columns held unpacked at a time
NONE = np.iinfo(np.int64).min   # stands for a null among whole numbers


def _next_of_same(line: pa.Array) -> np.ndarray:
    """Of every row but the first: has it the line of the row before? A null is never the same."""
    if pa.types.is_struct(line.type):
        return np.logical_and.reduce([_next_of_same(f) for f in line.flatten()])
    return pc.fill_null(pc.equal(line[1:], line[:-1]), False).to_numpy(zero_copy_only=False)


def _whole(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.cast(column, pa.int64()), NONE).to_numpy(zero_copy_only=False)


def _width_of(*values: np.ndarray) -> int:
    """The fewest of 1, 2, 4 or 8 bytes that hold all of them."""
    low, high = min(int(v.min()) for v in values), max(int(v.max()) for v in values)
    return next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)


def _packed_columns(columns: DataFrame, line: str, chunk: int = CHUNK) -> DataFrame:
    """Columns of a line that follow one another in a batch, ``chunk`` at most, as one row ``(line, columns)`` of bytes.

    The bytes are two widths of integers and, compressed, the first x, the steps from it, all first rows and all last rows.
    """
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, n = batch.column(0), batch.num_rows
            x, y0, y1 = (_whole(batch.column(i)) for i in (1, 2, 3))
            on = _next_of_same(own) & (x[1:] > x[:-1]) & (x[:-1] != NONE)
            starts = np.concatenate([[0], np.flatnonzero(~on) + 1])
            place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            starts = np.flatnonzero(place % chunk == 0)
            step = np.diff(x, prepend=x[:1])
            step[starts] = 0
            sizes = _width_of(step), _width_of(y0, y1)
            head, (step, y0, y1) = bytes(sizes), (v.astype(f"<i{k}") for v, k in ((step, sizes[0]), (y0, sizes[1]), (y1, sizes[1])))
            packed = [head + zlib.compress(b"".join((x[a:a + 1].astype("<i8").tobytes(), step[a + 1:b].tobytes(), y0[a:b].tobytes(), y1[a:b].tobytes())), 1)
                      for a, b in zip(starts, np.append(starts[1:], n))]
            yield pa.RecordBatch.from_arrays([own.take(pa.array(starts)), pa.array(packed, pa.binary())], [line, "columns"])

    return columns.select(line, "x", "y0", "y1").mapInArrow(run, f"{line} {dict(columns.dtypes)[line]}, columns binary")


def _unpacked_columns(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Number of columns of each piece, and x, y0 and y1 of all."""
    counts, out = [], ([], [], [])
    for piece in pieces:
        kx, ky, raw = piece[0], piece[1], zlib.decompress(piece[2:])
        n = (len(raw) - 8 + kx) // (kx + 2 * ky)
        at = 8 + kx * (n - 1)
        x = np.empty(n, np.int64)
        x[0], x[1:] = np.frombuffer(raw, "<i8", 1)[0], np.frombuffer(raw, f"<i{kx}", n - 1, 8)
        out[0].append(x.cumsum() if n > 1 else x)
        out[1].append(np.frombuffer(raw, f"<i{ky}", n, at))
        out[2].append(np.frombuffer(raw, f"<i{ky}", n, at + ky * n))
        counts.append(n)
    return np.array(counts, np.int64), *(np.concatenate(v).astype(np.int64) for v in out)


def _runs_of_lines(pieces: pa.ListArray, types: pa.DataType) -> pa.ListArray:
    """Runs of every line from its packed columns, in order. As places in a line less x, columns of a run are equal."""
    per_line = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
    counts, x, y0, y1 = _unpacked_columns(pieces.flatten().to_pylist())
    row = np.repeat(np.repeat(np.arange(len(pieces)), per_line), counts)
    rising = lambda: (row[1:] > row[:-1]) | (x[1:] > x[:-1])
    if not rising().all():
        order = np.lexsort((x, row))
        row, x, y0, y1 = (v[order] for v in (row, x, y0, y1))
    isle = np.where(x == NONE, NONE, x - np.where(x == NONE, 0, np.arange(len(x)) - np.searchsorted(row, row)))
    if not rising().all():   # where columns repeat, those of a run need not be neighbours
        order = np.lexsort((x, isle, row))
        row, x, y0, y1, isle = (v[order] for v in (row, x, y0, y1, isle))
    starts = np.concatenate([[0], np.flatnonzero((row[1:] != row[:-1]) | (isle[1:] != isle[:-1])) + 1])
    ends = np.append(starts[1:], len(x)) - 1
    fields = [x[starts], np.where(x[ends] == NONE, NONE, x[ends] + 1),
              np.minimum.reduceat(np.where(y0 == NONE, -(NONE + 1), y0), starts), np.maximum.reduceat(y1, starts)]
    order = np.lexsort((fields[1], fields[0], row[starts]))
    unknown = [fields[0] == NONE, fields[1] == NONE, fields[2] == -(NONE + 1), fields[3] == NONE]
    values = pa.StructArray.from_arrays(
        [pa.array(v[order], mask=u[order]).cast(f.type) for v, u, f in zip(fields, unknown, types)], fields=list(types))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[starts], np.arange(len(pieces) + 1)), pa.int32()), values)


def column_runs(columns: DataFrame, line: str = "line_id", chunk: int = CHUNK, packed: bool = False) -> DataFrame:
    """Maximal runs of adjacent inked columns; with ``packed`` one row a line, for the other operators of this module.

    Columns are packed where they are and shuffled once, a few bytes each, up to ``chunk`` in a row. Packed lines meet what is known of
    their lines (``beside``) before they are opened, so that neither runs nor keys repeated for them are shuffled again.
    Where columns repeat, those with the same difference of x and place in the line are one run.
    """
    pieces = _packed_columns(columns, line, chunk)
    kinds = {c: t for c, t in columns.dtypes if c in ("x", "y0", "y1")}
    # Rows are dealt by line first, as few lines have more than one row in a task.
    lines = pieces.repartition(line).groupBy(line).agg(F.collect_list("columns").alias("pieces"))
    lines = lines.select(line, F.col("pieces").alias("pieces", metadata={"kinds": kinds}))
    return lines if packed else unpacked(lines)


def is_packed(runs: DataFrame) -> bool:
    return "pieces" in runs.columns or "runs" in runs.columns


def _opened(lines: DataFrame) -> DataFrame:
    """Packed lines with the array ``runs`` of their runs, in order."""
    if "pieces" not in lines.columns:
        return lines
    kinds = lines.schema["pieces"].metadata["kinds"]
    names = ("x0", "x1", "y0", "y1")
    kinds = (kinds["x"], "bigint" if kinds["x"] == "bigint" else "int", kinds["y0"], kinds["y1"])
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.struct([pa.field(f, arrow[t]) for f, t in zip(names, kinds)])

    def runs(pieces):
        if not len(pieces):
            return pa.array([], pa.list_(schema))
        size = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False)) // (UNPACKED // CHUNK)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [len(pieces)]])
        return pa.concat_arrays([_runs_of_lines(pieces.slice(a, b - a), schema) for a, b in zip(cuts[:-1], cuts[1:])])

    found = F.arrow_udf(runs, "array<struct<" + ", ".join(f"{f}: {t}" for f, t in zip(names, kinds)) + ">>")
    return lines.withColumn("runs", found("pieces")).drop("pieces")


def _each(lines: DataFrame, structs, *keep: str) -> DataFrame:
    """A row for each of an array of structs. Not by ``inline``, whose check for empty arrays would open lines before they are joined, too."""
    rows = lines.select(*keep, F.posexplode_outer(structs).alias("_place", "_each"))
    return rows.filter(F.col("_place").isNotNull()).select(*keep, "_each.*")


def unpacked(runs: DataFrame) -> DataFrame:
    """One row a run, of packed lines or of runs."""
    if not is_packed(runs):
        return runs
    return _each(_opened(runs), F.col("runs"), *[c for c in runs.columns if c not in ("pieces", "runs", "texts")])


def beside(runs: DataFrame, lines: DataFrame, line: str = "line_id") -> DataFrame:
    """Packed lines opened, with the rows of ``lines`` that each has as the array ``texts``; lines that have none are left out."""
    texts = F.collect_list(F.struct(*[c for c in lines.columns if c != line])).alias("texts")
    return _opened(runs.join(lines.repartition(line).groupBy(line).agg(texts), line))


def _with_runs(lines: DataFrame, runs) -> DataFrame:
    return lines.select(*[c for c in lines.columns if c != "runs"], runs.alias("runs"))


def long_enough(runs: DataFrame, widths: DataFrame | None = None, line: str = "line_id", shortest: int = MIN_RUN) -> DataFrame:
    """Closed runs need a minimum length; a run that reaches the right edge does not. Packed lines may have their widths ``beside`` them."""
    if is_packed(runs):
        lines = runs if widths is None else beside(runs, widths, line)
        keep = lambda t: F.filter("runs", lambda r: (r["x1"] - r["x0"] >= shortest) | (r["x1"] == t["width"]))
        return _with_runs(lines, F.flatten(F.transform("texts", keep)))
    return runs.join(widths.select(line, "width"), line).filter(
        (F.col("x1") - F.col("x0") >= shortest) | (F.col("x1") == F.col("width"))
    ).drop("width")


def drop_narrow(segs: DataFrame, line: str = "line_id", share: float = NARROW) -> DataFrame:
    """Keep segments wider than a share of the upper median width of their line.

    The median of unpacked segments comes from a histogram of widths, not from a list of a line's segments.
    """
    if is_packed(segs):
        # Bound by a lambda, the median is worked out once a line.
        median = F.get(F.sort_array(F.transform("runs", lambda r: r["x1"] - r["x0"])), F.expr("size(runs) div 2"))
        wide = F.transform(F.array(median), lambda m: F.filter("runs", lambda r: r["x1"] - r["x0"] > m * share))
        return _with_runs(segs, F.flatten(wide))
    upto = W.partitionBy(line).orderBy("w").rowsBetween(W.unboundedPreceding, W.currentRow)
    medians = (
        segs.groupBy(line, (F.col("x1") - F.col("x0")).alias("w")).agg(F.count("*").alias("n"))
        .select(line, "w", F.sum("n").over(upto).alias("upto"), F.sum("n").over(W.partitionBy(line)).alias("all"))
        .filter(F.col("upto") > F.expr("`all` div 2"))
        .groupBy(line).agg(F.min("w").alias("median"))
    )
    return segs.join(medians, line).filter(F.col("x1") - F.col("x0") > F.col("median") * share).drop("median")


def number_segments(segs: DataFrame, line: str = "line_id") -> DataFrame:
    if is_packed(segs):
        numbered = F.transform(F.sort_array("runs"), lambda r, i: F.struct(*[r[f].alias(f) for f in ("x0", "x1", "y0", "y1")], i.alias("seg_no")))
        return _with_runs(segs, numbered)
    return segs.withColumn("seg_no", F.row_number().over(W.partitionBy(line).orderBy("x0")) - 1)


def with_chars(segs: DataFrame, chars, line: str = "line_id") -> DataFrame:
    """Numbered segments of packed lines, one row each, with the character of their number; ``chars`` lists those of one of the texts.

    Segments beyond the last character yield no row. Characters are listed where texts have met their segments.
    """
    paired = lambda c: F.transform(F.filter("runs", lambda r: r["seg_no"] < F.size(c)), lambda r: F.struct(
        r["seg_no"].alias("seg_no"), r["x0"].alias("x0"), r["x1"].alias("x1"), F.get(c, r["seg_no"]).alias("char")))
    return _each(segs, F.flatten(F.transform(F.transform("texts", chars), paired)), line)


def split_wide(segs: DataFrame, factor: float = WIDE) -> DataFrame:
    """Cut a segment wider than a multiple of its height into equal integer parts."""
    segs = unpacked(segs)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0") + 1
    n = F.greatest(F.ceil(w / F.greatest(h * factor, F.lit(1.0))), F.lit(1)).cast("int")
    return (
        segs.withColumn("_n", n)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_w", F.col("x1") - F.col("x0"))
        .withColumn("_x", F.col("x0"))
        .withColumn("x0", F.expr("_x + bigint(_w) * part div _n"))
        .withColumn("x1", F.expr("_x + bigint(_w) * (part + 1) div _n"))
        .drop("_n", "_w", "_x")
    )


def equal_split(bounds: DataFrame, n: str) -> DataFrame:
    """Cut the ink bounds ``[x0, x1)`` of a line into ``n`` equal integer parts.

    A line is cut in full or not at all: with fewer columns than parts, or no part asked for, it is
    given up and yields no row. Row bounds and other columns go along.
    """
    return bounds.filter((F.col(n) > 0) & (F.col("x1") - F.col("x0") >= F.col(n))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))).select(
        "*",
        F.expr(f"x0 + bigint(x1 - x0) * part div {n}").alias("a"),
        F.expr(f"x0 + bigint(x1 - x0) * (part + 1) div {n}").alias("b"),
    )


def fold_fragments(runs: list[tuple[int, int, int, int, bool]], share: float = FRAGMENT) -> list[tuple]:
    """Merge narrow pieces of one line into the neighbour over the smaller gap, right on a tie.

    ``runs`` are all column runs of the line in order, as (x0, x1, y0, y1, counts); runs that do
    not count are too short to be segments, yet their ink belongs to a piece that spans them.
    One look at the next segment decides the current one, so a single pass is enough.
    """
    done: list[list[int]] = []
    current: list[int] | None = None
    between: list[tuple[int, int]] = []      # extents of the short runs after ``current``

    def spanning(a, b, gap):
        ys = [(a[2], a[3]), (b[2], b[3]), *gap]
        return [a[0], b[1], min(y for y, _ in ys), max(y for _, y in ys)]

    def narrow(s):
        return (s[1] - s[0]) / (s[3] - s[2] + 1) < share

    gaps: list[list[tuple[int, int]]] = []   # short runs between done[i] and what follows it

    def join_left(s):
        done[-1] = spanning(done[-1], s, gaps[-1])

    for x0, x1, y0, y1, counts in runs:
        if not counts:
            between.append((y0, y1))
            continue
        nxt = [x0, x1, y0, y1]
        if current is None:
            current, between = nxt, []
            continue
        if narrow(current):
            left_gap = current[0] - done[-1][1] if done else float("inf")
            if nxt[0] - current[1] <= left_gap:
                current, between = spanning(current, nxt, between), []
                continue
            join_left(current)
            gaps[-1] = between
        else:
            done.append(current)
            gaps.append(between)
        current, between = nxt, []
    if current is not None:
        if done and narrow(current):
            join_left(current)
        else:
            done.append(current)
    return [tuple(s) for s in done]


def fold_closest(segs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Merge the adjacent pair with the smallest joint span, first on ties, until ``n`` remain."""
    alive = len(segs)
    start, end = [a for a, _ in segs], [b for _, b in segs]
    after = list(range(1, len(segs))) + [-1]
    before = [-1] + list(range(len(segs) - 1))
    heap = [(end[i + 1] - start[i], i, i + 1, end[i + 1]) for i in range(len(segs) - 1)]
    heapq.heapify(heap)
    dead = [False] * len(segs)
    while alive > max(n, 1) and heap:
        _, i, j, joint_end = heapq.heappop(heap)
        if dead[i] or dead[j] or after[i] != j or end[j] != joint_end:
            continue
        end[i], after[i], dead[j] = end[j], after[j], True
        alive -= 1
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(heap, (end[after[i]] - start[i], i, after[i], end[after[i]]))
        if before[i] >= 0:
            heapq.heappush(heap, (end[i] - start[before[i]], before[i], i, end[i]))
    return [(start[i], end[i]) for i in range(len(segs)) if not dead[i]]


def _per_line(segs: DataFrame, line: str, fields: list[str], fold, out: list[str], extra: list[str] = ()) -> DataFrame:
    """Apply an ordered fold to the segments of each line, many lines per Arrow batch.

    A line arrives as one row of parallel arrays; names in ``out`` may carry a type. Its length is bounded by the width of the line
    image, and lines are spread by their own key. ``segs`` are segments, or lines that have theirs under ``s``.
    """
    rows = segs if "s" in segs.columns else segs.groupBy(line, *extra).agg(F.collect_list(F.struct(*fields)).alias("s"))
    rows = rows.select(line, *extra, F.sort_array("s").alias("s")).select(line, *extra, *[F.col(f"s.{f}").alias(f) for f in fields])

    def run(batches):
        for pdf in batches:
            folded = [fold(*values) for values in zip(*[pdf[c] for c in [*fields, *extra]])]
            flat = [seg for one in folded for seg in one]
            result = pd.DataFrame(flat, columns=[c.split()[0] for c in out])
            result.insert(0, line, pdf[line].repeat([len(f) for f in folded]).to_numpy())
            yield result

    schema = f"{line} {dict(segs.dtypes)[line]}, " + ", ".join(c if " " in c else f"{c} bigint" for c in out)
    return rows.mapInPandas(run, schema)


def _few(fields: list[str]):
    """The runs of a line with some of their fields."""
    return F.transform("runs", lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def merge_fragments(runs: DataFrame, widths: DataFrame, line: str = "line_id", share: float = FRAGMENT) -> DataFrame:
    fields = ["x0", "x1", "y0", "y1"]
    long = lambda x0, x1, width: ((x1 - x0 >= MIN_RUN) | (x1 == width)).alias("counts")
    if is_packed(runs):
        counts = lambda t: F.transform("runs", lambda r: F.struct(*[r[f].alias(f) for f in fields], long(r["x0"], r["x1"], t["width"])))
        counted = beside(runs, widths.select(line, "width"), line).select(line, F.flatten(F.transform("texts", counts)).alias("s"))
    else:
        counted = runs.join(widths.select(line, "width"), line).withColumn("counts", long(F.col("x0"), F.col("x1"), F.col("width")))
    fold = lambda *cols: fold_fragments(list(zip(*cols)), share)
    return _per_line(counted, line, [*fields, "counts"], fold, fields)


def merge_to_count(segs: DataFrame, wanted: DataFrame | None = None, line: str = "line_id") -> DataFrame:
    """Repair over-segmented lines down to ``wanted(line, n_chars)`` segments; packed lines have ``n_chars`` of their own."""
    if is_packed(segs):
        joined = segs.select(line, "n_chars", _few(["x0", "x1"]).alias("s"))
    else:
        joined = segs.select(line, "x0", "x1").join(wanted.select(line, "n_chars"), line)
    fold = lambda x0, x1, n: fold_closest(list(zip(x0, x1)), int(n))
    return _per_line(joined, line, ["x0", "x1"], fold, ["x0", "x1"], ["n_chars"])


def fold_to_characters(runs: list[tuple[int, int, int, int]], width: int, chars: list[str]) -> list[tuple]:
    """(seg_no, char, x0, x1, y0, y1) of one line, a segment for each of ``chars``, or none at all.

    ``runs`` are all column runs in order. Those that are long and wide enough are segments. Too many are merged, with the
    rows of all ink they span; for too few, the ink of the line is cut into equal parts, which keep the line's rows.
    """
    long = [(a, b) for a, b, _, _ in runs if b - a >= MIN_RUN or b == width]
    if not long or not len(chars):
        return []
    median = sorted(b - a for a, b in long)[len(long) // 2]
    segs, n = [(a, b) for a, b in long if b - a > NARROW * median], len(chars)
    if len(segs) < n:
        x0, x1 = runs[0][0], runs[-1][1]
        if x1 - x0 < n:
            return []
        y0, y1 = min(r[2] for r in runs), max(r[3] for r in runs)
        return [(i, c, x0 + (x1 - x0) * i // n, x0 + (x1 - x0) * (i + 1) // n, y0, y1) for i, c in enumerate(chars)]
    out, at = [], 0
    for i, (a, b) in enumerate(fold_closest(segs, n)):
        while runs[at][0] < a:
            at += 1
        y0, y1 = runs[at][2], runs[at][3]
        while at < len(runs) and runs[at][1] <= b:
            y0, y1, at = min(y0, runs[at][2]), max(y1, runs[at][3]), at + 1
        out.append((i, chars[i], a, b, y0, y1))
    return out


def character_segments(runs: DataFrame, lines: DataFrame, line: str = "line_id") -> DataFrame:
    """Marks of lines from all their column runs and ``lines(line_id, width, chars)``: filtered, repaired to the number of
    characters and paired with them, in one pass over each line.

    Lines without characters, without a segment, or with fewer columns of ink than characters yield no row.
    """
    fields, lines = ["x0", "x1", "y0", "y1"], lines.filter(F.size("chars") > 0).select(line, "width", "chars")
    if is_packed(runs):
        # A line's texts that are alike are one, with the runs of all.
        each = beside(runs, lines, line).withColumn("text", F.explode(F.array_distinct("texts")))
        alike = F.size(F.filter("texts", lambda t: t.eqNullSafe(F.col("text"))))
        joined = each.select(line, "text.width", "text.chars", F.flatten(F.array_repeat(_few(fields), alike)).alias("s"))
    else:
        joined = runs.select(line, *fields).join(lines, line)
    fold = lambda x0, x1, y0, y1, width, chars: fold_to_characters(list(zip(x0, x1, y0, y1)), width, chars)
    return _per_line(joined, line, fields, fold, ["seg_no", "char string", "x0", "x1", "y0", "y1"], ["width", "chars"])
