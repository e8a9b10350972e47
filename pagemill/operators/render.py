"""Renderers and the drawing of a page's regions: faces, glyph banks, and chains of them.

A renderer settles a page's style once (``for_page``) and then draws texts into boxes; None means that
it has nothing to show, and the next of a chain is asked. Draws depend on seed, page and region only. A
region whose text is blank, or whose sides are under three pixels, or that no renderer draws, stays
without ink: its size is 0, it has no clusters, and it counts as fitting. An error in one page is its own:
the page has no canvas, and ``error`` says why.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import glyphs, sampling, typeface, warps
from pagemill.operators import pixels as P
from pagemill.operators.fonts import REQUIRED

Made = tuple[np.ndarray, list[typeface.Cluster], int]
#: Sides under this are not drawn on; the largest starting size without a known ink height; size to ink height.
LEAST_SIDE, LARGEST, SIZE_SCALE = 3, 48, 0.95
#: Bytes of font files that go to every executor.
MOST_BYTES = 64 << 20


class PageRenderer(Protocol):
    style: dict[str, str]

    def draw(self, text: str, width: int, height: int, start: int, g: random.Random) -> Made | None: ...


class Renderer(Protocol):
    def for_page(self, index: int, texts: Sequence[str]) -> PageRenderer: ...


def renderable(text: Column, width: Column, height: Column) -> Column:
    """Whether a region has a text to show and room for it."""
    from pagemill.functions.text import py_strip

    return (py_strip(F.coalesce(text, F.lit(""))) != "") & (width >= LEAST_SIDE) & (height >= LEAST_SIDE)


def guarded(face: typeface.Face, name: str, required: Sequence[int] = REQUIRED) -> typeface.Face:
    """``face``, if it has every required code point; an error names some that it lacks."""
    lacks = face.missing(required)
    if lacks:
        raise ValueError(f"{name} lacks {len(lacks)} required characters, such as {''.join(map(chr, sorted(lacks)[:8]))}")
    return face


@dataclass
class FontPage:
    face: typeface.Face
    style: dict[str, str]
    bold: bool = False
    slant: float = 0.0
    warp: float = 0.0
    shaper: typeface.Shaper = typeface.by_character

    def draw(self, text: str, width: int, height: int, start: int, g: random.Random) -> Made | None:
        make = lambda k: typeface.render_block(text, self.face, width * k, height * k, start * k, bold=self.bold, slant=self.slant, shaper=self.shaper)
        return warps.warped(make, self.warp, g) if self.warp else make(1)


@dataclass
class FontRenderer:
    """Text in a face that each page draws from a bank, or in one ``fixed`` face for all pages."""

    faces: dict[str, bytes]  # by path
    bank: list[sampling.Face]
    fixed: str | None = None
    seed: int = sampling.SEED
    shaper: typeface.Shaper = typeface.by_character
    _read: dict[str, typeface.Face] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        size = sum(map(len, self.faces.values()))
        if size > MOST_BYTES:
            raise ValueError(f"font files of {size} bytes; at most {MOST_BYTES} are sent to executors")
        if self.fixed is not None:
            guarded(self.face(self.fixed), self.fixed)

    def face(self, path: str) -> typeface.Face:
        if path not in self._read:
            self._read[path] = typeface.Face.read(self.faces[path])
        return self._read[path]

    def for_page(self, index: int, texts: Sequence[str]) -> FontPage:
        if self.fixed is not None:
            return FontPage(self.face(self.fixed), {"font": self.fixed, "font_file": self.fixed, "category": "fixed"}, shaper=self.shaper)
        path, family, category, weight, bold, warp, slant = sampling.style_at(index, len(texts), self.bank, self.seed)
        style = {"font": family, "font_file": path, "category": category, "weight": str(weight), "faux_bold": str(bold).lower(), "slant": str(slant), "warp": str(warp)}
        return FontPage(self.face(path), style, bold, slant, warp, self.shaper)


@dataclass
class GlyphRenderer:
    """Handwriting from a bank; texts of which it knows too few characters are left to others."""

    bank: glyphs.Bank
    least_coverage: float = glyphs.LEAST_COVERAGE
    face: bytes | None = None  # for characters that the bank lacks
    style: dict[str, str] = field(default_factory=lambda: {"glyph_bank": "true"})

    def for_page(self, index: int, texts: Sequence[str]) -> GlyphRenderer:
        return self

    def draw(self, text: str, width: int, height: int, start: int, g: random.Random) -> Made | None:
        if glyphs.coverage(text, self.bank) < self.least_coverage:
            return None
        return glyphs.block(text, self.bank, width, height, start, g, in_face(typeface.face_of(self.face)) if self.face else None)


def in_face(face: typeface.Face) -> glyphs.Fallback:
    """A character's ink in a face, cropped to itself."""

    def ink(ch: str, size: int) -> np.ndarray | None:
        if not face.has(ch):
            return None
        drawn = typeface.shape_line(ch, face, size)[0]
        ys, xs = np.nonzero(drawn)
        return drawn[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] if len(xs) else None

    return ink


@dataclass
class Chain:
    """The first of ``members`` that has ink to show."""

    members: Sequence[Renderer]

    def for_page(self, index: int, texts: Sequence[str]) -> ChainPage:
        return ChainPage([m.for_page(index, texts) for m in self.members])


@dataclass
class ChainPage:
    members: list[PageRenderer]

    @property
    def style(self) -> dict[str, str]:
        """Of all members; what an earlier one says stays."""
        return {k: v for m in reversed(self.members) for k, v in m.style.items()}

    def draw(self, text: str, width: int, height: int, start: int, g: random.Random) -> Made | None:
        for m in self.members:
            made = m.draw(text, width, height, start, g)
            if made is not None and made[0].any():
                return made
        return None


def first_made(*made: Column) -> Column:
    """The chain as columns: the first result that is not null."""
    return F.coalesce(*made)


def merged_style(*styles: Column) -> Column:
    """The chain's style as columns: maps of which an earlier one's entries stay."""

    def both(first: Column, rest: Column) -> Column:
        return F.map_concat(first, F.map_filter(rest, lambda k, _: ~F.map_contains_key(first, k)))

    return reduce(lambda rest, s: both(s, rest), reversed(styles))


_BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
DRAWN = f"region_idx:bigint,size:int,fit:boolean,clusters:array<struct<text:string,box:{_BOX}>>"


def drawn(pages: DataFrame, regions: DataFrame, renderer: Renderer | None, seed: int, padding: float = 0.1, size_scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Images (page_id, width, height, rgb, style, error) and (page_id, region_idx, size, fit, clusters) of
    erased ``pages`` (with ``colours`` and perhaps ``page_idx``) on which ``shown`` of each region is drawn.
    Without a renderer pages stay erased."""
    shared = pages.sparkSession.sparkContext.broadcast(renderer)
    item = F.struct("region_idx", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], F.coalesce("shown", F.lit("")).alias("shown"), F.coalesce("ink_height", F.lit(0.0)).alias("ink_height"))
    rows = pages.join(regions.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items")), "page_id", "left")
    index = F.col("page_idx") if "page_idx" in pages.columns else F.lit(0).cast("long")

    @F.pandas_udf(f"rgb binary, style map<string,string>, error string, done array<struct<{DRAWN}>>")
    def run(page_id: pd.Series, page_idx: pd.Series, width: pd.Series, height: pd.Series, rgb: pd.Series, items: pd.Series, colours: pd.Series) -> pd.DataFrame:
        out = []
        for n, k, w, h, p, i, c in zip(page_id, page_idx, width, height, rgb, items, colours, strict=True):
            if p is None or i is None:
                out.append((p, {}, None, []))
                continue
            try:
                out.append(one(str(n), int(k), P.pixels(w, h, p).copy(), i, c))
            except Exception as e:  # noqa: BLE001 - a page that fails must not end the run
                out.append((None, {}, f"{type(e).__name__}: {e}", []))
        return pd.DataFrame(out, columns=["rgb", "style", "error", "done"])

    def one(name: str, index: int, canvas: np.ndarray, items: list, colours: list) -> tuple:
        page = shared.value.for_page(index, [r["shown"] for r in items]) if shared.value is not None else None
        done = []
        for r, colour in zip(items, colours, strict=True):
            w, h = r["x2"] - r["x1"], r["y2"] - r["y1"]
            label = {"region_idx": int(r["region_idx"]), "size": 0, "fit": True, "clusters": []}
            done.append(label)
            if page is None or not r["shown"].strip() or w < LEAST_SIDE or h < LEAST_SIDE:
                continue
            inner = [max(4, round(v * (1 - padding))) for v in (w, h)]
            start = round(r["ink_height"] * size_scale) or min(LARGEST, inner[1])
            made = page.draw(r["shown"], *inner, start, random.Random(f"{seed}/{name}/{r['region_idx']}"))
            if made is None:
                continue
            ink, clusters, size = made
            slack = h - ink.shape[0]
            x = r["x1"] + max(0, (w - ink.shape[1]) // 2)
            y = r["y1"] + (slack // 2 if 0 <= slack <= 12 else max(1, round(h * padding / 2)))
            rgba = np.empty((*ink.shape, 4), dtype=np.uint8)
            rgba[..., :3], rgba[..., 3] = [colour[c] for c in "rgb"], ink
            P.composite(canvas, rgba, x, y)
            label |= {"size": size, "fit": ink.shape[1] <= w + 1 and ink.shape[0] <= h + 1}
            label["clusters"] = [{"text": t, "box": {"x1": b[0] + x, "y1": b[1] + y, "x2": b[2] + x, "y2": b[3] + y}} for t, b in clusters]
        return canvas.tobytes(), page.style if page is not None else {}, None, done

    made = rows.withColumn("d", run("page_id", index, "width", "height", "rgb", "items", "colours"))
    return made.select("page_id", "width", "height", "d.rgb", "d.style", "d.error"), made.select("page_id", F.inline("d.done"))


def outside(labels: DataFrame, slack: int = 2) -> DataFrame:
    """The clusters (page_id, region_idx, text, box) of ``labels`` that leave their region's box by more than
    ``slack`` pixels: a check of the labels."""
    rows = labels.select("page_id", "region_idx", "x1", "y1", "x2", "y2", F.explode("clusters").alias("c"))
    b = F.col("c.box")
    leaves = (b["x1"] < F.col("x1") - slack) | (b["y1"] < F.col("y1") - slack) | (b["x2"] > F.col("x2") + slack) | (b["y2"] > F.col("y2") + slack)
    return rows.where(leaves).select("page_id", "region_idx", F.col("c.text").alias("text"), b.alias("box"))


Shrink = Callable[[np.ndarray, int, int], np.ndarray]


def fit_to_box(ink: np.ndarray, clusters: list[typeface.Cluster], width: int, height: int) -> tuple[np.ndarray, list[typeface.Cluster]]:
    """Ink cropped to itself, and shrunk with its boxes where it is wider or higher than the box."""
    ys, xs = np.nonzero(ink)
    if not len(xs):
        return ink, clusters
    x0, y0 = int(xs.min()), int(ys.min())
    ink = ink[y0 : int(ys.max()) + 1, x0 : int(xs.max()) + 1]
    scale = min(1.0, width / ink.shape[1], height / ink.shape[0])
    moved = [(t, tuple(round((v - o) * scale) for v, o in zip(b, (x0, y0, x0, y0), strict=True))) for t, b in clusters]
    if scale < 1:
        ink = P.area_resized(ink[..., None], max(1, round(ink.shape[1] * scale)), max(1, round(ink.shape[0] * scale)))[..., 0]
    return ink, moved
