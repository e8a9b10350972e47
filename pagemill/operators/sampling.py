"""Draws that depend on a page's index and nothing else, whatever the number of partitions."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The seed and its stride, and the mix of categories.
SEED, STRIDE = 20260626, 7919
CATEGORY_WEIGHTS = {"sans": 0.42, "serif": 0.18, "handwriting": 0.25, "display": 0.10, "monospace": 0.05}
OTHER_WEIGHT = 0.03
TRIES = 64
SPARSE, P_HAND, P_BOLD, P_ITALIC, P_WARP, SLANT, WARP = 25, 0.10, 0.10, 0.01, 0.50, 0.15, (0.5, 1.1)

#: (path, family, category, weight, italic)
Face = tuple[str, str, str, int, bool]


def locale_of(page_idx: Column, p_years: float = 0.30, p_digits: float = 0.25, seed: int = SEED) -> Column:
    """A struct (years, digits); both draws are always made, years first."""

    @F.pandas_udf("years boolean, digits boolean")
    def draw(index: pd.Series) -> pd.DataFrame:
        gens = [random.Random(seed + int(i) * STRIDE) for i in index]
        return pd.DataFrame([(g.random() < p_years, g.random() < p_digits) for g in gens], columns=["years", "digits"])

    return draw(page_idx)


def _grouped(faces: Sequence[Face]) -> dict[str, dict[str, list[Face]]]:
    out: dict[str, dict[str, list[Face]]] = {}
    for face in faces:
        out.setdefault(face[2], {}).setdefault(face[1], []).append(face)
    return out


def face_of(g: random.Random, families: dict[str, dict[str, list[Face]]], weights: dict[str, float], covers: Callable[[Face], bool] | None = None) -> Face:
    """A category by its weight, a family of it, a face of that. With ``covers`` the draw is made again, up to
    ``TRIES`` times, until a face can show the text; then any face that can is taken, or an error raised."""
    categories = sorted(families)
    for _ in range(TRIES if covers else 1):
        group = families[g.choices(categories, [weights.get(c, OTHER_WEIGHT) for c in categories])[0]]
        face = g.choice(group[g.choice(list(group))])
        if covers is None or covers(face):
            return face
    every = [f for c in categories for faces in families[c].values() for f in faces if covers(f)]
    if not every:
        raise ValueError("no face can show the text")
    return g.choice(every)


def style_at(index: int, n: int, faces: Sequence[Face], seed: int = SEED, covers: Callable[[Face], bool] | None = None) -> tuple:
    """(path, family, category, weight, faux bold, warp, slant) of the page with ``n`` regions."""
    families = _grouped(faces)
    g = random.Random(seed + index * STRIDE)
    g.random(), g.random()  # the locale's draws
    hand = n <= SPARSE and g.random() < P_HAND
    face = face_of(g, families, {"handwriting": 1.0} if hand else CATEGORY_WEIGHTS, covers)
    bold = g.random() < P_BOLD
    heavy = [f for f in families[face[2]][face[1]] if f[3] >= 600 and f[4] == face[4]] if bold else []
    shown = max(heavy, key=lambda f: f[3]) if heavy else face
    warp = warp_strength(g) if hand and g.random() < P_WARP else 0.0
    slant = SLANT if g.random() < P_ITALIC else 0.0
    return shown[0], shown[1], shown[2], shown[3], bold and shown is face, warp, slant


def warp_strength(g: random.Random, low: float = WARP[0], high: float = WARP[1]) -> float:
    """Never more than ``WARP`` allows, beyond which clusters run into each other."""
    return g.uniform(low, min(high, WARP[1]))


def style_of(page_idx: Column, regions: Column, faces: Sequence[Face], seed: int = SEED) -> Column:
    """A page's type style, drawn after its locale: whether it is handwritten (pages of few regions
    only), a face (category, family, face), bold, warp (handwritten pages only) and slant."""
    schema = "path string, family string, category string, weight int, faux_bold boolean, warp double, slant double"

    @F.pandas_udf(schema)
    def draw(index: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([style_at(int(i), int(k), faces, seed) for i, k in zip(index, n, strict=True)], columns=[x.split()[0] for x in schema.split(", ")])

    return draw(page_idx, regions)
