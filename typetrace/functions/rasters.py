"""Small NumPy helpers for one Arrow batch of images; used inside Spark tasks only.

Stacks have shape (n, height, width). Nothing here keeps state or sees more than one batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

GLYPH_SIDE = 128   # side of a normalised glyph
INDEX_SIDE = 64    # side of the stored bitmap and field
INK_ABOVE = 32     # a pixel of a normalised glyph is ink above this level
HALF_LEVEL = 127   # and of a re-sampled bitmap above this one


def as_image(px, height: int, width: int) -> np.ndarray:
    """Raw payload (bytes or an integer array) to a (height, width) level image."""
    flat = np.frombuffer(px, np.uint8) if isinstance(px, (bytes, bytearray)) else np.asarray(px)
    return flat.astype(np.uint8, copy=False).reshape(int(height), int(width))


def unpack(words, n_words: int) -> np.ndarray:
    """Rows of 64-bit words to rows of zeros and ones."""
    w = np.stack([np.asarray(v, dtype=np.int64) for v in words]).reshape(len(words), n_words)
    return np.unpackbits(np.ascontiguousarray(w.astype(">i8")).view(np.uint8), axis=1)


def pack(bits: np.ndarray) -> np.ndarray:
    """(n, 64 * k) zeros and ones to (n, k) signed words."""
    packed = np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=1))
    return packed.view(">i8").astype(np.int64)


def otsu(gray: np.ndarray) -> int:
    """Level with the largest between-class variance; the lowest one wins ties."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    valid = (below > 0) & (above > 0)
    if not valid.any():
        return 0
    b, a = np.where(valid, below, 1.0), np.where(valid, above, 1.0)
    variance = np.where(valid, b * a * (mass / b - (mass[-1] - mass) / a) ** 2, -1.0)
    return int(np.argmax(variance))


def ink_of(gray: np.ndarray) -> np.ndarray | None:
    """Ink mask: the minority side of the threshold, dark on a tie; None without ink."""
    dark = gray <= otsu(gray)
    n_dark = int(dark.sum())
    ink = dark if n_dark * 2 <= dark.size else ~dark
    return ink if ink.any() else None


def runs_of(ink: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of inked columns as (starts, ends, first rows, last rows)."""
    full = np.concatenate([[0], ink.any(axis=0).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(full) > 0), np.flatnonzero(np.diff(full) < 0)
    first, last = ink.argmax(axis=0), len(ink) - 1 - ink[::-1].argmax(axis=0)
    low, high = np.where(full[1:-1] > 0, first, len(ink)), np.where(full[1:-1] > 0, last, -1)
    return starts, ends, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)


def trim(mask: np.ndarray) -> np.ndarray:
    """Cut away empty rows and columns around the ink."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return mask[ys[0]:ys[-1] + 1, xs[0]:xs[-1] + 1]


@lru_cache(maxsize=4096)
def _triangle_weights(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) weights of an antialiased bilinear resize, in 22-bit fixed point."""
    ratio = n_in / n_out
    reach = max(ratio, 1.0)
    centre = (np.arange(n_out) + 0.5) * ratio
    lo = np.maximum((centre - reach + 0.5).astype(int), 0)
    hi = np.minimum((centre + reach + 0.5).astype(int), n_in)
    at = np.arange(n_in)
    w = np.maximum(1.0 - np.abs(at[None, :] + 0.5 - centre[:, None]) / reach, 0.0)
    w[(at[None, :] < lo[:, None]) | (at[None, :] >= hi[:, None])] = 0.0
    w /= w.sum(axis=1, keepdims=True)
    return np.floor(w * (1 << 22) + 0.5)


def _apply_weights(weights: np.ndarray, stack: np.ndarray) -> np.ndarray:
    total = np.floor((weights @ stack + (1 << 21)) / (1 << 22))
    return np.clip(total, 0, 255)


def resize_bilinear(levels: np.ndarray, height: int, width: int) -> np.ndarray:
    """8-bit bilinear resize of (..., h, w): columns first, each pass rounded to whole levels."""
    out = levels.astype(np.float64)
    if out.shape[-1] != width:
        turned = np.swapaxes(out, -1, -2)
        out = np.swapaxes(_apply_weights(_triangle_weights(out.shape[-1], width), turned), -1, -2)
    if out.shape[-2] != height:
        out = _apply_weights(_triangle_weights(out.shape[-2], height), out)
    return out


def resize_nearest(stack: np.ndarray, side: int) -> np.ndarray:
    """Nearest resize of (..., h, w) to a square, source index floor((i + 0.5) * ratio)."""
    h, w = stack.shape[-2:]
    rows = ((np.arange(side) + 0.5) * (h / side)).astype(int)
    cols = ((np.arange(side) + 0.5) * (w / side)).astype(int)
    return stack[..., rows[:, None], cols[None, :]]


def fit_and_centre(mask: np.ndarray, side: int = GLYPH_SIDE) -> np.ndarray:
    """Scale a 0/1 mask into a square keeping its shape, centre it and threshold again."""
    h, w = mask.shape
    scale = min(side / h, side / w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    canvas = np.zeros((side, side), dtype=np.uint8)
    top, left = (side - nh) // 2, (side - nw) // 2
    levels = resize_bilinear(mask.astype(np.uint8) * 255, nh, nw)
    canvas[top:top + nh, left:left + nw] = levels > INK_ABOVE
    return canvas


def normalise(gray: np.ndarray, side: int = GLYPH_SIDE) -> np.ndarray | None:
    ink = ink_of(gray)
    return None if ink is None else fit_and_centre(trim(ink), side)


def distance_to_background(stack: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every ink pixel to the nearest background pixel of its image."""
    ink = np.asarray(stack) > 0
    n, h, w = ink.shape
    run = np.where(ink, np.inf, 0.0)
    for x in range(1, w):
        np.minimum(run[:, :, x], run[:, :, x - 1] + 1, out=run[:, :, x])
    for x in range(w - 2, -1, -1):
        np.minimum(run[:, :, x], run[:, :, x + 1] + 1, out=run[:, :, x])
    square = run * run
    rows = np.arange(h, dtype=np.float64)
    best = np.empty_like(square)
    for y in range(h):
        best[:, y, :] = (square + ((rows - y) ** 2)[None, :, None]).min(axis=1)
    return np.sqrt(best)


def signed_field(stack: np.ndarray) -> np.ndarray:
    """Signed distance (outside positive) over its own spread; zeros when it has none."""
    flat = stack.reshape(len(stack), -1) > 0
    mixed = flat.any(axis=1) & ~flat.all(axis=1)
    field = np.zeros(stack.shape, dtype=np.float64)
    if mixed.any():
        part = stack[mixed] > 0
        signed = distance_to_background(~part) - distance_to_background(part)
        spread = signed.reshape(len(signed), -1).std(axis=1)
        spread = np.where(spread > 1e-6, spread, np.inf)
        field[mixed] = signed / spread[:, None, None]
    return field


def orientation_histogram(stack: np.ndarray, cells: int = 8, bins: int = 8) -> np.ndarray:
    """Magnitude-weighted gradient directions per cell, folded to half a turn, unit length."""
    img = stack.astype(np.float64)
    n, h, w = img.shape
    gy, gx = np.gradient(img, axis=(1, 2))
    # Directions are folded in single precision: an edge straight up then falls one bin
    # below an edge straight down, which the scores of the original rule depend on.
    angle = (np.arctan2(gy.astype(np.float32), gx.astype(np.float32)) + np.float32(np.pi)) % np.float32(np.pi)
    slot = np.clip((angle / np.float32(np.pi / bins)).astype(int), 0, bins - 1)
    cell_y = (np.arange(h) // (h // cells))[None, :, None]
    cell_x = (np.arange(w) // (w // cells))[None, None, :]
    key = ((np.arange(n)[:, None, None] * cells + cell_y) * cells + cell_x) * bins + slot
    hist = np.bincount(key.ravel(), np.hypot(gy, gx).ravel(), minlength=n * cells * cells * bins)
    hist = hist.reshape(n, -1)
    length = np.linalg.norm(hist, axis=1, keepdims=True)
    return np.where(length > 1e-9, hist / np.where(length > 1e-9, length, 1.0), hist)


def shifts(reach: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]


def shifted(stack: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Move the content of (n, h, w) by (dy, dx), zeros coming in at the border."""
    out = np.zeros_like(stack)
    h, w = stack.shape[1:]
    if abs(dy) < h and abs(dx) < w:
        out[:, max(0, dy):h + min(0, dy), max(0, dx):w + min(0, dx)] = \
            stack[:, max(0, -dy):h - max(0, dy), max(0, -dx):w - max(0, dx)]
    return out


def shift_moments(fields: np.ndarray, reach: int) -> np.ndarray:
    """Centred square sum of every zero-filled shift of every field, (n, shifts)."""
    size = fields.shape[1] * fields.shape[2]
    out = []
    for dy, dx in shifts(reach):
        s = shifted(fields, dy, dx).reshape(len(fields), -1)
        out.append((s * s).sum(axis=1) - s.sum(axis=1) ** 2 / size)
    return np.stack(out, axis=1)


def aligned_correlation(queries: np.ndarray, fields: np.ndarray, moments: np.ndarray, reach: int) -> np.ndarray:
    """Best correlation over all shifts of each field against each query, (n_queries, n_fields).

    Shifting the centred query the other way gives the same numerator, so each shift is one
    matrix product; the shifted fields' norms come from ``moments``.
    """
    flat = queries.reshape(len(queries), -1)
    centred = (flat - flat.mean(axis=1, keepdims=True)).reshape(queries.shape)
    energy = (centred ** 2).reshape(len(queries), -1).sum(axis=1)
    target = fields.reshape(len(fields), -1)
    best = np.zeros((len(queries), len(fields)))
    for j, (dy, dx) in enumerate(shifts(reach)):
        numerator = shifted(centred, -dy, -dx).reshape(len(queries), -1) @ target.T
        denom = np.sqrt(np.maximum(energy[:, None] * moments[None, :, j], 0.0))
        score = np.where(denom < 1e-9, 0.0, numerator / np.where(denom < 1e-9, 1.0, denom))
        np.maximum(best, score, out=best)
    return np.minimum(best, 1.0)


def aligned_pairs(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Best correlation over all shifts for row-wise pairs of fields, (n,)."""
    n, size = len(a), a.shape[1] * a.shape[2]
    flat = a.reshape(n, -1)
    centred = flat - flat.mean(axis=1, keepdims=True)
    energy = (centred ** 2).sum(axis=1)
    best = np.zeros(n)
    for dy, dx in shifts(reach):
        moved = shifted(b, dy, dx).reshape(n, -1)
        spread = (moved * moved).sum(axis=1) - moved.sum(axis=1) ** 2 / size
        denom = np.sqrt(np.maximum(energy * spread, 0.0))
        score = np.where(denom < 1e-9, 0.0, (centred * moved).sum(axis=1) / np.where(denom < 1e-9, 1.0, denom))
        np.maximum(best, score, out=best)
    return np.minimum(best, 1.0)


def gaussian_blur(levels: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian over (h, w) levels with repeated borders, truncated to whole levels."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def along(size: int) -> np.ndarray:
        at = np.clip(np.arange(size)[:, None] + np.arange(-reach, reach + 1)[None, :], 0, size - 1)
        weights = np.zeros((size, size))
        np.add.at(weights, (np.arange(size)[:, None], at), kernel[None, :])
        return weights

    h, w = levels.shape
    return np.clip(np.floor(along(h) @ levels @ along(w).T + 1e-9), 0, 255)
