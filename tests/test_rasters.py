"""Batch helpers against naive loops and hand-made values."""

import math

import numpy as np

from typetrace.functions import rasters as R

rng = np.random.default_rng(3)


def test_pack_round_trip():
    bits = rng.integers(0, 2, (5, 256)).astype(np.uint8)
    assert (R.unpack(list(R.pack(bits)), 4) == bits).all()
    assert R.pack(np.eye(1, 64, 0))[0, 0] == -(2 ** 63)


def test_otsu_and_polarity():
    assert R.otsu(np.full((4, 4), 200, np.uint8)) == 0
    half = np.array([[10, 10, 240, 240]] * 4, np.uint8)
    assert R.otsu(half) == 10
    assert (R.ink_of(half) == (half == 10)).all()          # tie: dark is ink
    mostly_dark = np.array([[10, 10, 10, 240]] * 4, np.uint8)
    assert (R.ink_of(mostly_dark) == (mostly_dark == 240)).all()
    assert R.ink_of(np.full((3, 3), 7, np.uint8)) is None   # all above level 0: no dark pixel is ink
    assert R.normalise(np.full((3, 3), 7, np.uint8)) is None


def test_distance_equals_brute_force():
    stack = rng.integers(0, 2, (6, 9, 9))
    got = R.distance_to_background(stack)
    for n in range(6):
        zeros = np.argwhere(stack[n] == 0)
        for y in range(9):
            for x in range(9):
                want = 0 if stack[n, y, x] == 0 else min(math.hypot(y - a, x - b) for a, b in zeros)
                assert abs(got[n, y, x] - want) < 1e-12
    assert np.isinf(R.distance_to_background(np.ones((1, 3, 3)))).all()


def test_signed_field_of_degenerate_images_is_zero():
    f = R.signed_field(np.stack([np.zeros((8, 8)), np.ones((8, 8)), np.eye(8)]))
    assert not f[0].any() and not f[1].any()
    assert abs(f[2].std() - 1) < 1e-9 and f[2][0, 7] > 0 > f[2][0, 0]


def test_orientation_of_blank_and_edge():
    blank = R.orientation_histogram(np.zeros((1, 16, 16)), 2, 8)
    assert not blank.any()
    edge = np.zeros((1, 16, 16))
    edge[:, :, 8:] = 1
    h = R.orientation_histogram(edge, 2, 8).reshape(4, 8)
    assert abs(np.linalg.norm(h) - 1) < 1e-9 and h[:, 0].all() and not h[:, 1:].any()


def test_shift_search_finds_small_shifts_only():
    f = rng.normal(size=(1, 64, 64))
    two, three = R.shifted(f, 2, -1), R.shifted(f, 3, 0)
    assert R.aligned_pairs(two, f, 2)[0] > 0.95
    assert R.aligned_pairs(three, f, 2)[0] < 0.5
    many = rng.normal(size=(7, 16, 16))
    grid = R.aligned_correlation(many, many, R.shift_moments(many, 2), 2)
    for i in range(7):
        for j in range(7):
            assert abs(grid[i, j] - R.aligned_pairs(many[i:i + 1], many[j:j + 1], 2)[0]) < 1e-9
    assert (grid.argmax(axis=1) == np.arange(7)).all()


def test_shift_search_equals_plain_loop():
    a, b = rng.normal(size=(8, 8)), rng.normal(size=(8, 8))
    best = 0.0
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            s = np.zeros((8, 8))
            for y in range(8):
                for x in range(8):
                    if 0 <= y - dy < 8 and 0 <= x - dx < 8:
                        s[y, x] = b[y - dy, x - dx]
            p, q = a - a.mean(), s - s.mean()
            best = max(best, (p * q).sum() / math.sqrt((p * p).sum() * (q * q).sum()))
    assert abs(R.aligned_pairs(a[None], b[None], 2)[0] - best) < 1e-12


def test_resizes():
    img = rng.integers(0, 256, (5, 7)).astype(float)
    assert (R.resize_bilinear(img, 5, 7) == img).all()
    assert (R.resize_bilinear(np.full((3, 3), 77.0), 11, 2) == 77).all()
    # two pixels to four: a quarter of the way in between, rounded to whole levels
    assert R.resize_bilinear(np.array([[0.0, 100.0]]), 1, 4).tolist() == [[0, 25, 75, 100]]
    # four to two: weights 1 3 3 1 over eight at the centre, cut and renormalised at the border
    assert R.resize_bilinear(np.array([[0.0, 0.0, 70.0, 70.0]]), 1, 2).tolist() == [[10, 60]]
    assert R.resize_nearest(np.arange(16).reshape(1, 4, 4), 2).tolist() == [[[5, 7], [13, 15]]]


def test_fit_keeps_shape_and_centres():
    b = R.fit_and_centre(np.ones((10, 40), np.uint8), 128)
    ys, xs = np.nonzero(b)
    assert (ys.min(), ys.max() + 1, xs.min(), xs.max() + 1) == (48, 80, 0, 128)


def test_runs_of_mask():
    m = np.array([[1, 0, 1, 1, 0, 0, 1], [1, 0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0, 1]], bool)
    assert [r.tolist() for r in R.runs_of(m)] == [[0, 2, 6], [1, 4, 7], [0, 0, 0], [1, 2, 2]]
