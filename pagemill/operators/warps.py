"""Handwriting from static faces: each cluster moved on its own, then the line bent smoothly."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np

from pagemill.operators.pixels import area_resized

# Most strength, the glyph height that magnitudes are for and the least one, degrees, share of
# size, and shifts of a cluster; spread and reach of the field; ink that counts as a cluster's; drawing scale.
MOST, USUAL, LEAST, TURN, GROW, SHIFT, SPREAD, REACH, INK, TIMES = 1.1, 100.0, 8.0, 8.0, 0.13, (4.0, 13.0), 16.0, 14.0, 30, 3

Cluster = tuple[str, tuple[int, int, int, int]]


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, nearest: bool = False) -> np.ndarray:
    """``image`` at places (x, y), zero beyond its edges; between pixels linear, or the nearest."""
    wide = np.pad(image, 1)
    h, w = image.shape
    if nearest:
        i, j = np.clip(np.rint(y).astype(int) + 1, 0, h + 1), np.clip(np.rint(x).astype(int) + 1, 0, w + 1)
        return wide[i, j]
    x, y = np.clip(x + 1, 0, w + 1), np.clip(y + 1, 0, h + 1)
    i, j = np.minimum(y.astype(int), h), np.minimum(x.astype(int), w)
    dy, dx = y - i, x - j
    return (wide[i, j] * (1 - dx) + wide[i, j + 1] * dx) * (1 - dy) + (wide[i + 1, j] * (1 - dx) + wide[i + 1, j + 1] * dx) * dy


def label_map(ink: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The number (from 1) of the cluster whose ink a pixel is."""
    labels = np.zeros(ink.shape, dtype=np.int32)
    for k, (x1, y1, x2, y2) in enumerate(boxes, 1):
        labels[y1:y2, x1:x2][ink[y1:y2, x1:x2] > INK] = k
    return labels


def boxes_of(labels: np.ndarray, n: int) -> list[tuple[int, int, int, int] | None]:
    """The box of each label's pixels, if it has any."""
    out: list[tuple[int, int, int, int] | None] = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        out.append((int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None)
    return out


def jitter(ink: np.ndarray, labels: np.ndarray, n: int, g: random.Random, strength: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Each cluster turned and scaled about its centre and shifted, further up and down than sideways."""
    out, named = np.zeros_like(ink), np.zeros_like(labels)
    gy, gx = np.mgrid[: ink.shape[0], : ink.shape[1]]
    for k in range(1, n + 1):
        own = labels == k
        ys, xs = np.nonzero(own)
        if not len(xs):
            continue
        turn, grow = np.radians(g.uniform(-TURN, TURN) * strength), 1 + g.uniform(-GROW, GROW) * strength
        right, down = (g.uniform(-s, s) * strength * scale for s in SHIFT)
        cx, cy = xs.mean(), ys.mean()
        u, v = gx - cx - right, gy - cy - down  # back from where a pixel goes to where it comes from
        x = cx + (np.cos(turn) * u - np.sin(turn) * v) / grow
        y = cy + (np.sin(turn) * u + np.cos(turn) * v) / grow
        out = np.maximum(out, sampled(np.where(own, ink, 0).astype(np.float64), x, y).astype(ink.dtype))
        moved = sampled(own.astype(np.int32), x, y, nearest=True)
        named = np.where(moved > 0, k, named)
    return out, named


def _smooth(noise: np.ndarray, sigma: float) -> np.ndarray:
    half = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        wide = np.pad(noise, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric" if noise.shape[axis] > half else "edge")
        noise = np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=axis) @ k
    return noise


def elastic(ink: np.ndarray, labels: np.ndarray, n: int, g: random.Random, strength: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """A smooth random field of shifts."""
    state = np.random.default_rng(g.randrange(2**32))

    def field() -> np.ndarray:
        f = _smooth(state.uniform(-1, 1, ink.shape), SPREAD * scale)
        return f * (REACH * strength * scale / (np.abs(f).max() + 1e-6))

    gy, gx = np.mgrid[: ink.shape[0], : ink.shape[1]]
    x, y = gx + field(), gy + field()
    return sampled(ink.astype(np.float64), x, y).astype(ink.dtype), sampled(labels, x, y, nearest=True)


#: The steps of a warp, in order; callers may put in their own.
STEPS: tuple[Callable, ...] = (jitter, elastic)


def warped(draw: Callable[[int], tuple[np.ndarray, list[Cluster], int] | None], strength: float, g: random.Random, times: int = TIMES, steps: tuple[Callable, ...] = STEPS) -> tuple[np.ndarray, list[Cluster], int] | None:
    """What ``draw`` makes at ``times`` its size, warped and shrunk; boxes are taken from where each cluster's
    pixels end up, and a cluster that has none left goes."""
    made = draw(times)
    if made is None:
        return None
    ink, clusters, size = made
    boxes = [b for _, b in clusters]
    labels = label_map(ink, boxes)
    tall = [b[3] - b[1] for b in boxes if b[3] > b[1]]
    scale = max(LEAST, float(np.median(tall))) / USUAL if tall else 1.0
    for step in steps:
        ink, labels = step(ink, labels, len(boxes), g, min(strength, MOST), scale)
    h, w = max(1, ink.shape[0] // times), max(1, ink.shape[1] // times)
    small = area_resized(ink[..., None], w, h)[..., 0]
    down = lambda b: (b[0] // times, b[1] // times, min(w, -(-b[2] // times)), min(h, -(-b[3] // times)))
    return small, [(t, down(b)) for (t, _), b in zip(clusters, boxes_of(labels, len(boxes)), strict=True) if b], max(1, size // times)
