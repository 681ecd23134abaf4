"""Both search forms, task bounds, band pruning and real glyph sizes against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typetrace.functions import rasters as R
from typetrace.operators import fields as D, search
from typetrace.plans import fixtures as fx, matching, streams

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def small(spark):
    return fx.crops(spark, SF).cache(), fx.templates(spark, SF).cache()


def test_forms_and_task_bounds_agree(spark, small):
    crops, templates = small
    cols = ("mark_id", "font_id", "rank", "score")
    want = rows(search.match_marks_joined(crops, templates, 1, coarse_k=20), *cols)
    for crops_per_task, fonts_per_task in ((1000, 2000), (90, 2000), (150, 17)):
        got = search.match_marks(crops, templates, 1, 8, coarse_k=20,
                                 crops_per_task=crops_per_task, fonts_per_task=fonts_per_task)
        assert rows(got, *cols) == want
    assert rows(search.match_marks(crops.repartition(3), templates.repartition(5), 1, 8, coarse_k=20), *cols) == want


@pytest.mark.parametrize("packed_bytes", [0, 1 << 20])
def test_packed_and_dealt_short_lists_agree(spark, small, packed_bytes):
    """An index over its limit is dealt, one within it is held by every task; some crops have an unknown character."""
    crops, templates = small
    crops = crops.withColumn("char", F.when(F.col("mark_id") % 7 == 0, F.lit("?")).when(F.col("mark_id") % 7 == 1, F.lit(None).cast("string")).otherwise(F.col("char")))
    cols = ("mark_id", "font_id", "rank", "iou", "score")
    want = rows(search.match_marks_joined(crops, templates, 1, coarse_k=9), *cols)
    for fonts_per_task in (2000, 17):
        got = search.match_marks(crops, templates, 1, 8, coarse_k=9, fonts_per_task=fonts_per_task, packed_bytes=packed_bytes)
        assert rows(got, *cols) == want
    only = search.match_marks(crops, templates, 1, 8, use_fields=False, packed_bytes=packed_bytes)
    assert rows(only, *cols[:3]) == rows(search.match_marks_joined(crops, templates, 1, use_fields=False), *cols[:3])


def test_packed_index_is_checked_by_size(small):
    _, templates = small
    n = templates.count()
    assert search.packed_index(templates, 1, 24 * n - 1) is None
    index = search.packed_index(templates, 1, 24 * n)
    assert sum(len(f) for f, _ in index.values()) == n and all((np.diff(f) > 0).all() for f, _ in index.values())


def test_packed_short_lists_take_no_exchange(spark, tmp_path):
    """Crops are moved once, with their fields, after their short lists are known; templates' bitmaps are in no exchange."""
    fx.crops(spark, SF).write.parquet(str(tmp_path / "q"))
    fx.templates(spark, SF).write.parquet(str(tmp_path / "t"))
    q, t = spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "t"))
    plan = search.match_marks(q, t, 1, 8)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and plan.count("MapInArrow") == 1
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below[:below.index("Scan parquet")]
    dealt = search.match_marks(q, t, 1, 8, packed_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("FlatMapCoGroupsInPandas") == 2 and len(exchanges) < dealt.count("Exchange hashpartitioning")
    coarse = dealt[dealt.rindex("FlatMapCoGroupsInPandas"):].splitlines()
    last = max(i for i, line in enumerate(coarse) if "words#" in line)
    assert not any("field#" in line for line in coarse[:last + 1] if "Exchange" in line)


def test_hot_character_is_dealt_over_tasks(spark, small):
    crops, templates = small
    hot = crops.withColumn("char", F.lit("a"))
    q, t = search.deal(hot, templates, "char", 100, 2000)
    load = q.groupBy("char", "q_part", "t_part").count().agg(F.max("count"), F.count("*")).first()
    assert load[0] < 200 and load[1] == 20
    assert t.count() == 20 * templates.filter("char = 'a'").count()


def test_band_prune_changes_nothing(spark, small):
    crops, templates = small
    cols = ("mark_id", "font_id", "char", "rank", "iou", "score")
    want = rows(search.search_grid(crops, templates, 1, 8, prune=False), *cols)
    for size in (30, 120):
        assert rows(search.search_grid(crops, templates, 1, 8, templates_per_task=size), *cols) == want
    assert len(want) == 10 * crops.count()


@pytest.mark.parametrize("n_words", [1, 3])
def test_best_overlaps_are_those_of_the_whole_matrix(n_words):
    """Blank, equal and sparse bitmaps, ties, and bands of several sizes; only few pairs are ever sorted."""
    rng = np.random.default_rng(5)
    for density in (0.5, 0.04):
        q, t = (R.pack((rng.random((n, 64 * n_words)) < density).astype(np.uint8)) for n in (200, 3000))
        q[:5], t[50:60], t[100:200], q[20:40] = 0, 0, t[:100], t[:20]
        iou = search.overlap_matrix(R.unpack(q, n_words), R.unpack(t, n_words))
        for k in (1, 10, 4000):
            want = np.argsort(-iou, axis=1, kind="stable")[:, :k]
            for band in (None, 30, 700):
                place, best = search.best_overlaps(q, t, k, band)
                assert (place == want).all() and (best == np.take_along_axis(iou, want, axis=1)).all()


def test_grid_search_copies_few_queries(spark, small):
    """Queries meet the whole index in one task, however small its bands; an index over its limit is cut and gives the same rows."""
    crops, templates = small
    cols = ("mark_id", "font_id", "char", "rank", "iou", "score")
    want = rows(search.search_grid(crops, templates, 1, 8), *cols)
    assert rows(search.search_grid(crops, templates, 1, 8, queries_per_task=70, bitmap_bytes=24 * 40, templates_per_task=9), *cols) == want
    plan = search.search_grid(crops, templates, 1, 8, templates_per_task=9)._jdf.queryExecution().toString()
    assert "sequence(0, 0" in plan and "choices" not in plan


def test_joined_form_sends_lists_and_keeps_unknown_fields(spark, small):
    """No pair is a row before it is listed and no field is copied for a pair; glyphs without a field, repeated marks and fonts are kept."""
    crops, templates = small
    unknown = lambda df, key: df.drop("words", "pop", "vec", "centred", "centred_ss").withColumn(
        "field", F.when(F.col(key) % 5 == 0, None).when(F.col(key) % 5 == 1, F.transform("field", lambda v, i: F.when(i != 3, v))).otherwise(F.col("field")))
    q = unknown(crops.unionByName(crops.filter("mark_id % 4 = 2")), "mark_id")
    t = unknown(templates.unionByName(templates.filter("font_id % 3 = 1")), "font_id")
    q, t = (search.with_features(df, "field", 1).cache() for df in (q, t))
    cols = ("request_id", "mark_id", "char", "font_id", "rank", "coarse_rank", "iou", "ncc", "cosine", "score")
    got = search.match_marks_joined(q, t, 1, coarse_k=9)
    plain = search.coarse_candidates(q, t, 1, k=None).filter("coarse_rank <= 9")
    order = [F.desc("score"), F.asc("font_id")]
    want = search._first(search.refine(plain, q, t), ["mark_id"], order, 5, "rank").withColumn("rank", F.col("rank") - 1)
    loose = [c for c in cols if c != "coarse_rank"]   # equal rows may change places
    assert rows(got, *loose) == rows(want, *loose)
    assert got.filter("score = 0").count() > 0
    pairs = search.refine_listed(search.coarse_candidates(q, t, 1, 9), q, t, rows_per_task=11)
    assert rows(pairs, *[c for c in loose if c != "rank"]) == rows(search.refine(plain, q, t), *[c for c in loose if c != "rank"])
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("FlatMapCoGroupsInPandas") == 2 and "t_words" not in text


def test_exhaustive_search_has_no_coarse_cut(spark, small):
    crops, templates = small
    everything = search.match_marks(crops, templates, 1, 8, coarse_k=None, top_k=1000)
    per_char = {r.char: r["count"] for r in templates.groupBy("char").count().collect()}
    got = everything.groupBy("mark_id", "char").count().collect()
    assert all(r["count"] == per_char[r.char] for r in got) and len(got) == crops.count()


def test_absent_character_gives_no_row(spark, small):
    crops, templates = small
    found = search.match_marks(crops, templates.filter("char <> 'b'"), 1, 8)
    assert found.filter("char = 'b'").isEmpty() and not found.isEmpty()


def test_full_size_search_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    glyphs = []
    for font in range(6):
        for char in "ab":
            img = np.zeros((128, 128), np.uint8)
            for _ in range(5):
                y, x = rng.integers(0, 100, 2)
                h, w = (6, 60) if rng.random() < 0.5 else (60, 6)
                img[y:y + h, x:x + w] = 1
            glyphs.append((font, char, img))
    bits = lambda b: R.pack(b.reshape(1, -1))[0].tolist()
    index = D.build_index(spark.createDataFrame(
        [(f, c, bits(b)) for f, c, b in glyphs], "font_id bigint, char string, bits array<bigint>"))
    moved = [R.shifted(b[None], 2, -2)[0] for _, _, b in glyphs]
    crops = D.crop_features(spark.createDataFrame(
        [(1, i, c, bits(m)) for i, ((_, c, _), m) in enumerate(zip(glyphs, moved))],
        "request_id bigint, mark_id bigint, char string, bits array<bigint>"))
    got = {(r.mark_id, r.font_id): r.score
           for r in search.match_marks(crops, index, 64, 64, reach=2, top_k=6).collect()}

    halved = {(r.mark_id, r.font_id): r.score for r in search.match_marks(
        D.compact(crops), D.compact(index), 64, 64, reach=2, top_k=6).collect()}
    assert all(abs(halved[k] - v) < 1e-6 for k, v in got.items())

    def features(b, from_index):
        small = R.resize_nearest(b[None], 64)
        big = (R.resize_bilinear(small * 255, 128, 128) > 127) if from_index else b[None]
        return R.signed_field(small), R.orientation_histogram(big)[0]

    for i, (_, c, _) in enumerate(glyphs):
        qf, qv = features(moved[i], False)
        for f, tc, b in glyphs:
            if tc == c:
                tf, tv = features(b, True)
                want = 0.65 * R.aligned_pairs(qf, tf, 2)[0] + 0.35 * min(max(qv @ tv, 0), 1)
                assert abs(got[(i, f)] - want) < 1e-9
        assert max((f for f in range(6)), key=lambda f: got[(i, f)]) == glyphs[i][0]


def test_blank_template_scores_zero(spark):
    index = D.build_index(spark.createDataFrame([(1, "a", None)], "font_id bigint, char string, bits array<bigint>"))
    row = index.first()
    assert row["pop"] == 0 and not any(row["field"]) and not any(row["vec"])


def test_coarse_stage_reads_no_field_and_limits_early(spark, tmp_path):
    fx.crops(spark, SF).write.parquet(str(tmp_path / "q"))
    fx.templates(spark, SF).write.parquet(str(tmp_path / "t"))
    q, t = spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "t"))
    plan = search.coarse_candidates(q, t, 1)._jdf.queryExecution().executedPlan().toString()
    assert "centred" not in plan and "field" not in plan and "WindowGroupLimit" in plan


@pytest.mark.parametrize("coarse", ["popcount", "byte_weighted"])
def test_coarse_only_forms_agree(spark, small, coarse):
    crops, templates = small
    cols = ("mark_id", "font_id", "rank", "score")
    want = rows(search.match_marks_joined(crops, templates, 1, use_fields=False, coarse=coarse), *cols)
    for fonts_per_task in (2000, 17):
        got = search.match_marks(crops, templates, 1, 8, use_fields=False, coarse=coarse, fonts_per_task=fonts_per_task)
        assert rows(got, *cols) == want
    full = rows(search.match_marks_joined(crops, templates, 1, coarse_k=5, coarse=coarse), *cols)
    assert rows(search.match_marks(crops, templates, 1, 8, coarse_k=5, coarse=coarse), *cols) == full


def test_byte_weighted_grid_visits_all_bands(spark, small):
    crops, templates = small
    cols = ("mark_id", "font_id", "char", "rank", "iou")
    one, many = (rows(search.search_grid(crops, templates, 1, 8, coarse="byte_weighted", templates_per_task=n), *cols) for n in (10_000, 50))
    assert one == many and len(one) == 10 * crops.count()


def test_fields_stay_out_of_coarse_shuffles(spark, tmp_path):
    fx.crops(spark, SF).write.parquet(str(tmp_path / "q"))
    fx.templates(spark, SF).write.parquet(str(tmp_path / "t"))
    q, t = spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "t"))
    plan = search.match_marks(q, t, 1, 8, use_fields=False)._jdf.queryExecution().executedPlan().toString()
    assert "field:" not in plan and "vec:" not in plan and "field#" not in plan
    grid = search.search_grid(q, t, 1, 8, prune=False)._jdf.queryExecution().executedPlan().toString()
    lines = grid[grid.index("FlatMapCoGroupsInPandas"):].splitlines()
    refining = next(i for i, line in enumerate(lines) if "_field" in line)   # the branches that fetch fields follow
    assert refining > 5 and not any("field#" in line or "vec#" in line for line in lines[:refining])


def test_a_scorer_of_the_user(spark, small):
    """Both searches rank by what the scorer says of field correlation and orientation."""
    crops, templates = small
    one = crops.filter("mark_id % 9 = 0")
    only_orientation = lambda ncc, cosine: cosine  # noqa: E731  (defined here, so that it travels by value)
    for search_by in (lambda **how: search.match_marks(one, templates, 1, 8, **how), lambda **how: search.search_grid(one, templates, 1, 8, **how)):
        usual, own = search_by(), search_by(scorer=only_orientation).cache()
        assert own.filter("abs(score - cosine) > 1e-12").isEmpty() and own.count() == usual.count()
        assert rows(own, "mark_id", "font_id", "rank") != rows(usual, "mark_id", "font_id", "rank")
        assert rows(search_by(scorer=search.weighted()), "mark_id", "font_id", "score") == rows(usual, "mark_id", "font_id", "score")


def test_first_k_of_many_ties():
    rng = np.random.default_rng(3)
    iou = rng.integers(0, 6, (30, 200)) / 5
    for k in (1, 7, 199, 200, 300):
        assert (search.first_k(iou, k) == np.argsort(-iou, axis=1, kind="stable")[:, :k]).all()


def test_listed_pairs_score_as_the_matrix(monkeypatch):
    rng = np.random.default_rng(4)
    q = pd.DataFrame({"field": list(rng.normal(size=(9, 64))), "vec": list(rng.random((9, 32)))})
    t = pd.DataFrame({"field": list(rng.normal(size=(20, 64))), "vec": list(rng.random((20, 32)))})
    rows, columns = rng.integers(0, 9, 50), rng.integers(0, 20, 50)
    whole = search.fused_matrix(q, t, 8, 2, search.weighted())
    monkeypatch.setattr(search, "fused_matrix", None)
    for got, want in zip(search.fused_pairs(q, t, rows, columns, 8, 2, search.weighted(), block=7), whole):
        assert np.allclose(got, want[rows, columns], atol=1e-12)


class Shared:
    def __init__(self, value):
        self.value = value


def test_short_lists_of_a_packed_index_hold_no_whole_rows_of_overlaps():
    rng = np.random.default_rng(3)
    t_words = rng.integers(-1 << 63, 1 << 63, (50_000, 1), dtype=np.int64)
    t_words[40_000:] = t_words[:10_000]                       # ties go to the smaller font
    q_words = t_words[rng.integers(0, 50_000, 90)] ^ (1 << rng.integers(0, 60, (90, 1)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(90)), pa.array(["a"] * 89 + ["?"]), pa.array(q_words.tolist(), pa.list_(pa.int64()))], ["mark_id", "char", "words"])
    run = search._listed(Shared({"a": (np.arange(50_000) * 3, t_words)}), 1, 50, False, ["mark_id"])
    tracemalloc.start()
    got, = run([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    iou = search.overlap_matrix(R.unpack(q_words[:89], 1), R.unpack(t_words, 1))
    want = search.first_k(iou, 50)
    assert got.column("fonts").to_pylist() == (want * 3).tolist()
    assert np.array_equal(np.stack(got.column("ious").to_pylist()), np.take_along_axis(iou, want, axis=1))
    assert peak < 30 << 20, peak


@pytest.mark.parametrize("reach", [0, 2])
def test_listed_pairs_score_as_whole_matrices_and_equal_fields_alike(reach):
    rng = np.random.default_rng(4)
    fields, vecs = rng.normal(size=(40, 64)), rng.normal(size=(40, 16))
    fields[9], vecs[9], fields[7] = fields[5], vecs[5], 0.0
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    t = pd.DataFrame({"field": list(fields), "vec": list(vecs)})
    q = pd.DataFrame({"field": list(fields[:30] + rng.normal(size=(30, 64))), "vec": list(vecs[10:])})
    rows = np.repeat(np.arange(30), [0, 7, *[20] * 27, 0])
    columns = np.concatenate([np.sort(rng.permutation(40)[:n]) for n in np.bincount(rows, minlength=30)])
    got = search.fused_pairs(q, t, rows, columns, 8, reach, search.weighted())
    for one, all_ in zip(got, search.fused_matrix(q, t, 8, reach, search.weighted())):
        assert np.allclose(one, all_[rows, columns], atol=1e-12)
    score = search.fused_pairs(q, t, np.repeat(np.arange(30), 2), np.tile([5, 9], 30), 8, reach, search.weighted())[2]
    assert (score[::2] == score[1::2]).all()
    centred, fetched = np.stack(q["field"]), []
    counted = type("Counted", (np.ndarray,), {"__getitem__": lambda s, i: fetched.append(len(i)) or np.asarray(s)[i]})
    search._shifted_products(centred, fields.view(counted), rows, columns, 8, 2)
    assert sum(fetched) == len(rows)                          # once, not once a shift


def test_marks_that_disagree_are_searched_once(spark):
    plan = matching.disagreeing_marks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan


def test_files_of_spread_requests_hold_no_features(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(stream, *_):
        raise Seen(*stream.columns)

    monkeypatch.setattr(streams.J, "continuous_short_lists", seen)
    with pytest.raises(Seen) as found:
        streams.spread_requests(spark, SF)
    assert found.value.args == ("request_id", "mark_id", "char", "field", "ts")
