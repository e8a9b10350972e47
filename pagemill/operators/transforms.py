"""Page transforms: (images, regions) to (images, regions), a page at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import pixels as P

Transform = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
MARGIN, GAP, WHITE = 40, 24, 255


def keep(images: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return images, regions


def _boxed(images: DataFrame, regions: DataFrame) -> DataFrame:
    item = F.struct("region_idx", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return images.join(regions.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("boxes")), "page_id", "left")


def white_background(images: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """White paper everywhere but in the regions, which keep their pixels."""

    def one(w: int, h: int, p: bytes | None, own: list | None) -> bytes | None:
        if p is None:
            return None
        page, canvas = P.pixels(w, h, p), np.full((h, w, 3), WHITE, dtype=np.uint8)
        for b in own or ():
            at = slice(max(b["y1"], 0), b["y2"]), slice(max(b["x1"], 0), b["x2"])
            canvas[at] = page[at]
        return canvas.tobytes()

    run = P.sliced("binary", one)
    kept = [c for c in images.columns if c != "rgb"]
    return _boxed(images, regions).withColumn("rgb", run("width", "height", "rgb", "boxes")).select(*kept, "rgb"), regions


def stack(images: DataFrame, regions: DataFrame, margin: int = MARGIN, gap: int = GAP) -> tuple[DataFrame, DataFrame]:
    """The regions below each other in reading order, each with its pixels. A region wider than the column is
    shrunk to it; the page is as high as the regions are before that; a page without regions stays."""
    placed = "array<struct<region_idx:bigint,x1:int,y1:int,x2:int,y2:int,scale:double>>"

    def one(w: int, h: int | None, p: bytes | None, own: list | None) -> tuple:
        if p is None or not own:
            return h, p, []
        page, usable, y, done = P.pixels(w, h, p), max(1, w - 2 * margin), margin, []
        tall = margin + sum(b["y2"] - b["y1"] + gap for b in own)
        canvas = np.full((max(tall, margin), w, 3), WHITE, dtype=np.uint8)
        for b in own:
            crop = page[b["y1"] : b["y2"], b["x1"] : b["x2"]]
            wide = crop.shape[1]
            if wide > usable:
                crop = P.area_resized(crop, usable, max(1, round(crop.shape[0] * usable / wide)))
            part = canvas[y : y + crop.shape[0], margin : margin + crop.shape[1]]
            part[:] = crop[: part.shape[0], : part.shape[1]]
            done.append({"region_idx": int(b["region_idx"]), "x1": margin, "y1": y, "x2": margin + crop.shape[1], "y2": y + crop.shape[0], "scale": crop.shape[1] / max(1, wide)})
            y += crop.shape[0] + gap
        return len(canvas), canvas.tobytes(), done

    run = P.sliced(f"struct<height: int, rgb: binary, placed: {placed}>", one)
    made = _boxed(images, regions).withColumn("d", run("width", "height", "rgb", "boxes"))
    kept = [c for c in images.columns if c not in ("height", "rgb")]
    moved = made.select("page_id", F.inline("d.placed"))
    rest = [c for c in regions.columns if c not in ("x1", "y1", "x2", "y2", "ink_height")]
    back = regions.select(*rest, "ink_height").join(moved, ["page_id", "region_idx"]).withColumn("ink_height", F.col("ink_height") * F.col("scale")).drop("scale")
    return made.select(*kept, F.col("d.height").alias("height"), F.col("d.rgb").alias("rgb")), back.select(*regions.columns)
