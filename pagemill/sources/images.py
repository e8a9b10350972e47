"""Images: scans of image files, PNG encoding, and files of pages and previews."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.pixels import pixels
from pagemill.sources.files import put

#: The gap between a source page and its reconstruction, its colour, the boxes' colours.
GAP, GAP_COLOUR, REGION_COLOUR, CLUSTER_COLOUR = 12, 245, (220, 40, 40), (40, 120, 220)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb) of the image files under ``path``, at any depth. Spark decodes to
    rows of blue, green, red (and alpha), or grey; files that are no images are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for d, c, w, h in zip(data, channels, width, height, strict=True):
            p = np.frombuffer(d, dtype=np.uint8).reshape(h, w, c)
            out.append((np.repeat(p, 3, axis=2) if c == 1 else p[..., 2::-1]).tobytes())
        return pd.Series(out)

    path = F.coalesce(F.try_url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B"))), F.col("origin"))  # a URI
    return raw.select(path.alias("path"), "width", "height", rgb("data", "nChannels", "width", "height").alias("rgb"))


def page_images(pages: DataFrame, images: DataFrame, root: str, strict: bool = True) -> DataFrame:
    """(page_id, width, height, rgb): the image that each page names, relative to ``root``. A page
    without such an image raises an error, since its regions would have nothing to stand on; if not
    ``strict``, it has no pixels, and a column ``error`` says why."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), r"/(\./)+|//+", "/")
    wanted = F.when(F.col("image").startswith("/"), F.col("image")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("image")))
    found = pages.select("page_id", "image", tidy(wanted).alias("path")).join(images.withColumn("path", tidy(F.col("path"))), "path", "left")
    if not strict:
        lacks = F.when(F.col("rgb").isNull(), F.concat(F.lit("no image: "), F.coalesce("image", F.lit("null"))))
        return found.select("page_id", "width", "height", "rgb", lacks.alias("error"))
    there = F.when(F.col("rgb").isNull(), F.raise_error(F.concat(F.lit("no image: "), F.coalesce("image", F.lit("null"))))).otherwise(F.col("rgb"))
    return found.select("page_id", "width", "height", there.cast("binary").alias("rgb"))


def png(page: np.ndarray) -> bytes:
    """An RGB (or RGBA) image as PNG, rows filtered by their differences from the row above."""
    h, w, channels = page.shape
    rows = page.reshape(h, w * channels)
    up = np.diff(rows, axis=0, prepend=np.zeros((1, w * channels), dtype=np.uint8))
    body = np.concatenate([np.full((h, 1), 2, dtype=np.uint8), up], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def with_png(images: DataFrame) -> DataFrame:
    """``images`` with a column ``png`` in place of the pixels; null for a null image."""

    @F.pandas_udf("binary")
    def encoded(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else png(pixels(w, h, p)) for w, h, p in zip(width, height, rgb, strict=True)], dtype=object)

    return images.withColumn("png", encoded("width", "height", "rgb")).drop("rgb")


def write_images(images: DataFrame, path: str) -> DataFrame:
    """A PNG file named by its page under ``path`` for each image, and the (page_id, file) written.
    Of several images of one page that of the greatest bytes stays. Characters that a file name cannot
    hold are written as %XX."""
    there = images.where("rgb IS NOT NULL")
    if there.groupBy("page_id").count().where("count > 1").isEmpty():  # no image leaves its task
        files = with_png(there).withColumnRenamed("png", "data")
    else:
        files = with_png(there).groupBy("page_id").agg(F.max("png").alias("data"))
    name = F.concat(F.replace(F.url_encode(F.col("page_id").cast("string")), F.lit("+"), F.lit("%20")), F.lit(".png"))
    return put(files.select("page_id", name.alias("file"), "data"), path)


def _outlined(page: np.ndarray, box: dict, colour: tuple, wide: int) -> None:
    x1, y1, x2, y2 = (int(box[c]) for c in ("x1", "y1", "x2", "y2"))
    for k in range(wide):
        top, left, bottom, right = (max(v, 0) for v in (y1 + k, x1 + k, y2 - k, x2 - k))
        page[top : top + 1, left : right + 1] = page[bottom : bottom + 1, left : right + 1] = colour
        page[top : bottom + 1, left : left + 1] = page[top : bottom + 1, right : right + 1] = colour


def previews(sources: DataFrame, images: DataFrame, regions: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """(page_id, width, height, rgb) of the first ``limit`` pages by id: the source page, a gap, the
    reconstruction, with the boxes of ``regions`` if given. A page without a source is shown alone.
    The limit is the feature: previews are for people."""
    first = images.orderBy("page_id").limit(limit)
    left = sources.select("page_id", *[F.col(c).alias(f"source_{c}") for c in ("width", "height", "rgb")])
    rows = first.join(left, "page_id", "left")
    if regions is not None:
        boxes = regions.join(F.broadcast(first.select("page_id")), "page_id", "left_semi").groupBy("page_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))
        rows = rows.join(boxes, "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                right = pixels(row.width, row.height, row.rgb).copy()
                if getattr(row, "boxes", None) is not None:
                    for b in row.boxes:
                        _outlined(right, b, REGION_COLOUR, 2)
                if row.source_rgb is not None:
                    source = pixels(row.source_width, row.source_height, row.source_rgb)
                    sheet = np.full((max(len(source), len(right)), source.shape[1] + GAP + right.shape[1], 3), GAP_COLOUR, dtype=np.uint8)
                    sheet[: len(source), : source.shape[1]] = source
                    sheet[: len(right), source.shape[1] + GAP :] = right
                    right = sheet
                yield pd.DataFrame({"page_id": [row.page_id], "width": [right.shape[1]], "height": [right.shape[0]], "rgb": [right.tobytes()]})

    kind = images.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {kind}, width int, height int, rgb binary")
