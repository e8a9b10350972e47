"""Handwriting stitched from a bank of glyph images.

A bank has (char, inst, height, width, ink, text_height). Characters that the bank lacks are drawn in a
face, where one is given, and leave a gap of half a size where it has none either.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import pixels as P
from pagemill.sources.images import scan_images

# Shares of a size that glyphs of a band take, at least and at most; the gap between
# bases and its spread; the room above a baseline; the share of the em that a mark's image shows.
CLAMP = {"main": (0.62, 1.35), "above": (0.20, 0.55), "below": (0.20, 0.50)}
GAP, SPREAD, BASELINE, MARK_SHARE, LEAST_COVERAGE = 0.10, (-0.3, 0.4), 2.4, 0.45, 0.5
CIRCLE = "◌"
LINE, SMALLEST = 1.6, 8
#: Bytes of a bank that go to every executor.
MOST_BYTES = 64 << 20

Bank = dict[str, list[tuple[np.ndarray, float]]]
#: A character's ink at a size, cropped, or None where there is none.
Fallback = Callable[[str, int], np.ndarray | None]


def band_of(ch: str) -> str:
    return "above" if ch in T.ABOVE else "below" if ch in T.BELOW else "main"


def scan_bank(spark: SparkSession, path: str) -> DataFrame:
    """The images under ``path``/<character>/, dark on light, as ink; a mark's folder may carry the
    dotted circle. Instances are numbered by file name."""
    found = scan_images(spark, path)

    @F.pandas_udf("binary")
    def ink(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
        return pd.Series([(255 - P.luminance(P.pixels(w, h, p))).tobytes() for w, h, p in zip(width, height, rgb, strict=True)], dtype=object)

    char = F.replace(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1), F.lit(CIRCLE), F.lit(""))
    share = F.when(T.band(char) == "main", 1.0).otherwise(MARK_SHARE)
    rows = found.select(char.alias("char"), "path", "height", "width", ink("width", "height", "rgb").alias("ink"), F.greatest(F.lit(1.0), F.col("height") / share).alias("text_height"))
    return rows.where("char <> ''").withColumn("inst", F.row_number().over(Window.partitionBy("char").orderBy("path")) - 1).drop("path")


def loaded(bank: DataFrame) -> Bank:
    """A bank in memory, after a check of its size."""
    size = bank.agg(F.coalesce(F.sum(F.octet_length("ink")), F.lit(0))).first()[0]
    if not size:
        raise ValueError("the glyph bank is empty")
    if size > MOST_BYTES:
        raise ValueError(f"the glyph bank has {size} bytes; at most {MOST_BYTES} are sent to executors")
    out: Bank = {}
    for r in bank.orderBy("char", "inst").collect():
        out.setdefault(r.char, []).append((np.frombuffer(r.ink, dtype=np.uint8).reshape(r.height, r.width), r.text_height))
    return out


def coverage(text: str, bank: Bank) -> float:
    chars = [c for c in text if not c.isspace()]
    return sum(c in bank for c in chars) / len(chars) if chars else 0.0


def stitch(text: str, bank: Bank, size: int, g: random.Random, fallback: Fallback | None = None) -> tuple[np.ndarray, list[tuple[str, tuple[int, int, int, int]]]]:
    """A line's ink and the box of each cluster (text, box); white space belongs to the cluster before it."""
    usual = float(np.median([ink.shape[0] for c, many in bank.items() if band_of(c) == "main" for ink, _ in many] or [size]))
    base, pen, placed, groups = round(BASELINE * size), 0.0, [], []
    for cluster in re.findall(T.CLUSTER, text):
        if cluster.isspace():
            pen += size / 2
            if groups:
                groups[-1][0] += cluster
            continue
        groups.append([cluster, []])
        middle, top, bottom = pen, base - size, base
        for ch in cluster:
            band, other = band_of(ch), None
            if ch not in bank and (fallback is None or (other := fallback(ch, size)) is None):
                pen += size / 2 if band == "main" else 0
                continue
            if other is not None:
                ink, (h, w) = other, other.shape
            else:
                ink, _ = g.choice(bank[ch])
                low, high = CLAMP[band]
                h = max(1, round(size * min(max(ink.shape[0] / usual, low), high)))
                w = max(1, round(ink.shape[1] * h / ink.shape[0]))
            if band == "main":
                x, y = round(pen), base - h
                pen += w + GAP * h * (1 + g.uniform(*SPREAD))
                middle, top, bottom = x + w / 2, y, base
            elif band == "above":
                x, y = round(middle - w / 2), top - h - 1
                top = y
            else:
                x, y = round(middle - w / 2), bottom + 1
                bottom = y + h
            placed.append((x, y, P.area_resized(ink[..., None], w, h)[..., 0]))
            groups[-1][1].append((x, y, x + w, y + h))
    if not placed:
        return np.zeros((0, 0), dtype=np.uint8), []
    left, above = min(x for x, _, _ in placed), min(y for _, y, _ in placed)
    sheet = np.zeros((max(y + i.shape[0] for _, y, i in placed) - above, max(x + i.shape[1] for x, _, i in placed) - left), dtype=np.uint8)
    for x, y, ink in placed:
        part = sheet[y - above : y - above + ink.shape[0], x - left : x - left + ink.shape[1]]
        np.maximum(part, ink, out=part)
    union = lambda b: (min(v[0] for v in b) - left, min(v[1] for v in b) - above, max(v[2] for v in b) - left, max(v[3] for v in b) - above)
    return sheet, [(t, union(b)) for t, b in groups if b]


def block(text: str, bank: Bank, width: int, height: int, start: int, g: random.Random, fallback: Fallback | None = None) -> tuple[np.ndarray, list, int]:
    """Ink (h, w), clusters and size of a text wrapped into a box: the largest size from ``start`` down
    that fits, or the smallest. Each size is drawn from the same state, so it alone decides the look."""
    state, size = g.getstate(), max(start, SMALLEST)
    while True:
        g.setstate(state)
        rows, line = [], ""
        for word in re.findall(r"\S+\s*|\s+", text.strip()):
            if line and stitch((line + word).rstrip(), bank, size, random.Random(0), fallback)[0].shape[1] > width:
                rows.append(line)
                line = ""
            line += word
        drawn = [stitch(r.rstrip(), bank, size, g, fallback) for r in [*rows, line]]
        w = max(i.shape[1] for i, _ in drawn)
        tops = [round(k * LINE * size) for k in range(len(drawn))]
        h = max(y + i.shape[0] for y, (i, _) in zip(tops, drawn, strict=True))
        if size <= SMALLEST or (w <= width and h <= height):
            break
        size = max(SMALLEST, int(size * 0.9))
    sheet, clusters = np.zeros((h, w), dtype=np.uint8), []
    for y, (ink, own) in zip(tops, drawn, strict=True):
        part = sheet[y : y + ink.shape[0], : ink.shape[1]]
        np.maximum(part, ink, out=part)
        clusters += [(t, (b[0], b[1] + y, b[2], b[3] + y)) for t, b in own]
    return sheet, clusters, size
