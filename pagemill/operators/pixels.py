"""Pixels of a page: ink height, erasing of text, compositing.

An image table has (page_id, width, height, rgb): ``rgb`` holds height x width x 3 bytes, row by row.
Pages are independent, so each is one row of work; the regions of a page reach it as an array in
reading order, since overlapping regions are erased one after another on the same pixels. A page
without regions stays as it is; a null image gives nulls; boxes are clamped to the page, and a box
without pixels has ink height 0 and black ink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

# What counts as light paper, as flat paper and as ink, and how far ink is grown.
LIGHT, FLAT, INK_DROP, CORE_DROP, LOCAL_DROP, GROWN, RADIUS = 110, 8.0, 25, 50, 10, 2, 3
LEAST_CORE, WINDOW = 5, (11, 51)
BLACK = (0, 0, 0)
#: Bytes of pixels that a worker has as Python values at a time.
SLICE = 1 << 21
IMAGE = "page_id string, width int, height int, rgb binary"
COLOUR = "array<struct<r:int,g:int,b:int>>"


def luminance(rgb: np.ndarray) -> np.ndarray:
    """The luma of ITU-R 601 in 16-bit fixed point."""
    weighted = rgb.astype(np.uint32) @ np.array([19595, 38470, 7471], dtype=np.uint32)
    return ((weighted + 32768) >> 16).astype(np.uint8)


def ink_height(gray: np.ndarray) -> float:
    """From the first row with ink to the last; the height of the crop if fewer than two have any."""
    if not gray.size:
        return 0.0
    dark = np.flatnonzero(gray.min(axis=1) < np.percentile(gray, 85) - INK_DROP)
    return float(np.ptp(dark) + 1 if len(dark) > 1 else len(gray))


def _blurred(gray: np.ndarray, size: int) -> np.ndarray:
    """Gaussian means of windows of ``size`` pixels; edge pixels go on beyond the edge."""
    sigma, half = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    k = np.exp(-((np.arange(size) - half) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = gray.astype(np.float64)
    for axis in (0, 1):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis) @ k
    return np.rint(out)


def _grown(mask: np.ndarray, by: int) -> np.ndarray:
    """Every pixel no further than ``by`` rows and columns from one of ``mask``."""
    for axis in (0, 1):
        wide = np.pad(mask, [(by, by) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.lib.stride_tricks.sliding_window_view(wide, 2 * by + 1, axis=axis).any(axis=-1)
    return mask


def ink_mask(gray: np.ndarray) -> tuple[np.ndarray, bool]:
    """The ink of a crop, grown by two pixels, and whether it is dark on light."""
    dark = bool(np.median(gray) >= LIGHT)
    size = min(max(len(gray) | 1, WINDOW[0]), WINDOW[1])
    below = gray <= _blurred(gray, size) - LOCAL_DROP
    return _grown(below if dark else ~below, GROWN), dark


def ink_colour(rgb: np.ndarray, gray: np.ndarray, dark: bool) -> tuple[int, int, int]:
    """The colour of the strongest ink; black or white if there is next to none."""
    core = gray < np.percentile(gray, 85) - CORE_DROP if dark else gray > np.percentile(gray, 15) + CORE_DROP
    if np.count_nonzero(core) < LEAST_CORE:
        return BLACK if dark else (255, 255, 255)
    return tuple(np.percentile(rgb[core], 35 if dark else 65, axis=0).astype(int).tolist())


def _fronts(mask: np.ndarray) -> np.ndarray:
    """How many steps (up, down, left, right) each pixel of ``mask`` lies behind its edge; 0 outside."""
    depth, inside, step = np.zeros(mask.shape, dtype=np.int32), mask.copy(), 0
    while inside.any():
        step += 1
        known = np.pad(~inside, 1)
        edge = inside & (known[:-2, 1:-1] | known[2:, 1:-1] | known[1:-1, :-2] | known[1:-1, 2:])
        depth[edge] = step
        inside &= ~edge
    return depth


def inpaint(rgb: np.ndarray, mask: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """``mask`` filled from its edge inwards. A pixel is the weighted mean of the known pixels around
    it, each continued by its own gradient; near ones, ones along the normal of the front and ones of
    a like depth weigh more. Whole fronts are filled at a time, which keeps the work in numpy and the
    result the same in whatever order a front is read."""
    if not mask.any() or mask.all():
        return rgb.copy()
    h, w = mask.shape
    depth, out, r = _fronts(mask), rgb.astype(np.float64), radius
    padded = np.pad(depth.astype(np.float64), 1, mode="edge")
    normal = (padded[2:, 1:-1] - padded[:-2, 1:-1]) / 2, (padded[1:-1, 2:] - padded[1:-1, :-2]) / 2
    around = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if 0 < dy * dy + dx * dx <= r * r]
    known = ~mask
    for step in range(1, int(depth.max()) + 1):
        slopes = _slopes(out, known)
        y, x = np.nonzero(depth == step)
        total, weight = np.zeros((len(y), 3)), np.zeros(len(y))
        for dy, dx in around:
            qy, qx = y + dy, x + dx
            ok = (qy >= 0) & (qy < h) & (qx >= 0) & (qx < w)
            ok[ok] = known[qy[ok], qx[ok]]
            at, qy, qx = np.flatnonzero(ok), qy[ok], qx[ok]
            squared = dy * dy + dx * dx
            along = np.maximum(np.abs(dy * normal[0][y[at], x[at]] + dx * normal[1][y[at], x[at]]) / squared**0.5, 1e-6)
            share = along / squared / (1 + np.abs(depth[qy, qx] - step))
            total[at] += share[:, None] * (out[qy, qx] - dy * slopes[0][qy, qx] - dx * slopes[1][qy, qx])
            weight[at] += share
        out[y, x] = np.clip(total / weight[:, None], 0, 255)
        known[y, x] = True
    return np.rint(out).astype(np.uint8)


def _slopes(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences by row and by column where both neighbours are known, else 0."""
    out = []
    for axis in (0, 1):
        before, after = ([slice(None)] * 2 for _ in range(2))
        before[axis], after[axis] = slice(None, -2), slice(2, None)
        mid = [slice(None)] * 2
        mid[axis] = slice(1, -1)
        d = np.zeros_like(values)
        if values.shape[axis] > 2:
            both = known[tuple(before)] & known[tuple(after)]
            d[tuple(mid)] = np.where(both[..., None], (values[tuple(after)] - values[tuple(before)]) / 2, 0)
        out.append(d)
    return out[0], out[1]


def erase(rgb: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """A crop without its ink, and the ink's colour. Flat paper is filled, other paper inpainted."""
    gray = luminance(rgb)
    mask, dark = ink_mask(gray)
    colour, paper = ink_colour(rgb, gray, dark), gray[~mask]
    if paper.size and paper.std() >= FLAT:
        return inpaint(rgb, mask), colour
    fill = np.percentile(rgb.reshape(-1, 3), 80 if dark else 20, axis=0).astype(np.uint8)
    return np.where(mask[..., None], fill, rgb), colour


def composite(canvas: np.ndarray, ink: np.ndarray, x: int, y: int) -> None:
    """Lays ``ink`` (h, w, 4) over an opaque ``canvas``, in place; what lies outside is cut."""
    h, w = canvas.shape[:2]
    top, left, bottom, right = max(y, 0), max(x, 0), min(y + ink.shape[0], h), min(x + ink.shape[1], w)
    if top >= bottom or left >= right:
        return
    part = ink[top - y : bottom - y, left - x : right - x].astype(np.int32)
    under, alpha = canvas[top:bottom, left:right].astype(np.int32), part[..., 3:]
    canvas[top:bottom, left:right] = (part[..., :3] * alpha + under * (255 - alpha) + 127) // 255


# -- over tables ------------------------------------------------------------------------------


def pixels(width: int, height: int, rgb: bytes) -> np.ndarray:
    return np.frombuffer(rgb, dtype=np.uint8).reshape(int(height), int(width), 3)


def _clamped(box: dict, width: int, height: int) -> tuple[slice, slice]:
    x1, y1, x2, y2 = (min(max(int(box[c]), 0), most) for c, most in (("x1", width), ("y1", height), ("x2", width), ("y2", height)))
    return slice(y1, y2), slice(x1, x2)


def with_regions(images: DataFrame, regions: DataFrame) -> DataFrame:
    """``images`` with ``boxes``, each page's in reading order (empty for a page without regions)."""
    box = F.struct("region_idx", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    boxes = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return images.join(boxes, "page_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<struct<region_idx:bigint,x1:int,y1:int,x2:int,y2:int>>")))


def sliced(schema: str, one: Callable[..., object]) -> Callable[..., Column]:
    """A function of columns, the third of them pixels: ``one`` on the values of each row. Spark bounds an Arrow
    batch to 64 MB; beside it a worker holds the values and results of ``SLICE`` bytes of pixels."""
    kind = to_arrow_type(DataType.fromDDL(schema))

    @F.arrow_udf(schema)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            n, rgb = len(columns[0]), columns[2]
            rows = max(1, n * SLICE // max(rgb.nbytes, 1))
            for k in range(0, max(n, 1), rows):
                values = zip(*(c.slice(k, rows).to_pylist() for c in columns), strict=True)
                yield pa.array([one(*v) for v in values], kind)

    return run


def _per_page(schema: str, one: Callable[[np.ndarray, list], tuple]) -> Column:
    """``one`` on the pixels and boxes of each page; nulls for a null image."""
    none = (None,) * len(schema.split(", "))
    return sliced(f"struct<{schema}>", lambda w, h, p, b: none if p is None or b is None else one(pixels(w, h, p), b))("width", "height", "rgb", "boxes")


def measured(images: DataFrame, regions: DataFrame) -> DataFrame:
    """``regions`` with ink heights: those known, and of the others the heights of their dark pixels.
    Only pages with a region to measure are read."""
    unknown = regions.where(F.coalesce("ink_height", F.lit(0.0)) == 0)

    def heights(page: np.ndarray, boxes: list) -> tuple:
        gray = luminance(page)
        return ([{"region_idx": int(b["region_idx"]), "height": ink_height(gray[_clamped(b, page.shape[1], page.shape[0])])} for b in boxes],)

    found = with_regions(images.join(unknown.select("page_id").distinct(), "page_id", "left_semi"), unknown).select("page_id", _per_page("found array<struct<region_idx:bigint,height:double>>", heights).alias("m"))
    found = found.select("page_id", F.inline("m.found")).withColumnRenamed("height", "__height")
    known = F.coalesce(F.nullif(F.col("ink_height"), F.lit(0.0)), F.col("__height"), F.lit(0.0))
    return regions.join(found, ["page_id", "region_idx"], "left").withColumn("ink_height", known).drop("__height").select(*regions.columns)


def erased(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, width, height, rgb, colours): pages without the ink of their regions, and the ink's
    colour of each region in reading order."""

    def one(page: np.ndarray, boxes: list) -> tuple:
        canvas, colours = page.copy(), []
        for b in boxes:
            at = _clamped(b, canvas.shape[1], canvas.shape[0])
            colour = BLACK
            if canvas[at].size:
                canvas[at], colour = erase(canvas[at])
            colours.append(dict(zip("rgb", colour, strict=True)))
        return canvas.tobytes(), colours

    return with_regions(images, regions).withColumn("e", _per_page(f"rgb binary, colours {COLOUR}", one)).select("page_id", "width", "height", "e.rgb", "e.colours")


def kept(images: DataFrame, regions: DataFrame) -> DataFrame:
    """As ``erased``, but the pages stay as they are and all ink is black."""
    black = F.transform("boxes", lambda _: F.struct(*[F.lit(0).alias(c) for c in "rgb"]))
    return with_regions(images, regions).select("page_id", "width", "height", "rgb", black.cast(COLOUR).alias("colours"))


def downscaled(images: DataFrame, most: int) -> DataFrame:
    """Images of no side over ``most``, by means of the areas that fall on a pixel; box sides follow
    with ``layout.downscale``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = [shrunk(pixels(w, h, p), most) if p is not None else None for w, h, p in zip(rows.width, rows.height, rows.rgb, strict=True)]
            yield rows.assign(width=[w if d is None else d.shape[1] for w, d in zip(rows.width, done, strict=True)], height=[h if d is None else d.shape[0] for h, d in zip(rows.height, done, strict=True)], rgb=[None if d is None else d.tobytes() for d in done])

    fits = F.greatest("width", "height") <= most
    return images.where(F.coalesce(fits, F.lit(True))).unionByName(images.where(~fits).mapInPandas(run, images.schema))


def shrunk(page: np.ndarray, most: int) -> np.ndarray:
    factor = most / max(page.shape[:2])
    if factor >= 1:
        return page
    return area_resized(page, max(1, round(page.shape[1] * factor)), max(1, round(page.shape[0] * factor)))


def area_resized(page: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each new pixel is the mean of the area it covers, by differences of running sums."""
    out = page.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        edge = np.linspace(0, n, size + 1)
        low = np.minimum(edge.astype(int), n - 1)
        part = (edge - low).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        at = sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part
        out = np.diff(at, axis=axis) * size / n
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
