"""Text set in a typeface: metrics, outlines, line widths, wrapping, size fit, rendered blocks.

A face is read from the tables of a TrueType file. Shaping is a hook: a shaper maps (text, face) to the
glyphs of each cluster with their advances in units of the em; the one built in takes a glyph for each
character and its advance from the face, as fonts whose marks have no advance are drawn.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

#: Samples of a pixel's side, room between lines, and the smallest size that is tried.
SAMPLES, LINE, SMALLEST = 4, 1.35, 6
#: Characters of a metrics table that go to every executor.
MOST_CHARS = 70_000
#: Bytes of an Arrow batch that a worker has as Python values at a time.
SLICE = 1 << 20
Cluster = tuple[str, tuple[int, int, int, int]]
#: (cluster, glyphs as (glyph, x offset, y offset, advance)) of a text, in units of the em.
Shaper = Callable[[str, "Face"], list[tuple[str, list[tuple[int, float, float, float]]]]]


@dataclass
class Face:
    """A TrueType face: code points to glyphs, advances, and outlines in units of the em."""

    em: int
    ascent: int
    descent: int
    glyph_of: dict[int, int]
    advances: np.ndarray
    outlines: list[bytes]
    _flat: dict[int, list[np.ndarray]] = field(default_factory=dict)

    @classmethod
    def read(cls, data: bytes, index: int = 0) -> Face:
        """A face of a file; ValueError where it is no TrueType font with outlines."""
        try:
            start = struct.unpack_from(">I", data, 12 + 4 * index)[0] if data[:4] == b"ttcf" else 0
            at = {data[p : p + 4]: struct.unpack_from(">I", data, p + 8)[0] for p in range(start + 12, start + 12 + 16 * struct.unpack_from(">H", data, start + 4)[0], 16)}
            em, long_places = struct.unpack_from(">H", data, at[b"head"] + 18)[0], struct.unpack_from(">h", data, at[b"head"] + 50)[0]
            ascent, descent = struct.unpack_from(">hh", data, at[b"hhea"] + 4)
            n, n_advances = struct.unpack_from(">H", data, at[b"maxp"] + 4)[0], struct.unpack_from(">H", data, at[b"hhea"] + 34)[0]
            wide = np.frombuffer(data, ">u2", 2 * n_advances, at[b"hmtx"])[::2].astype(np.int64)
            advances = np.concatenate([wide, np.full(max(0, n - n_advances), wide[-1])])
            places = np.frombuffer(data, ">u4" if long_places else ">u2", n + 1, at[b"loca"]).astype(np.int64) * (1 if long_places else 2)
            glyf = at[b"glyf"]
            outlines = [data[glyf + a : glyf + b] for a, b in zip(places[:-1], places[1:], strict=True)]
            return cls(em, ascent, descent, glyph_map(data, at[b"cmap"]), advances, outlines)
        except (struct.error, KeyError, IndexError, ValueError) as e:
            raise ValueError("no TrueType face with outlines") from e

    def has(self, ch: str) -> bool:
        return ord(ch) in self.glyph_of

    def missing(self, required: Sequence[int]) -> list[int]:
        return [c for c in required if c not in self.glyph_of]

    def contours(self, glyph: int) -> list[np.ndarray]:
        """Closed polygons (points, 2) of a glyph; curves in four straight pieces."""
        if glyph not in self._flat:
            self._flat[glyph] = _contours(self, glyph, 0)
        return self._flat[glyph]


@lru_cache(maxsize=8)
def face_of(data: bytes) -> Face:
    return Face.read(data)


def glyph_map(data: bytes, at: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k in range(struct.unpack_from(">H", data, at + 2)[0]):
        platform, encoding, offset = struct.unpack_from(">HHI", data, at + 4 + 8 * k)
        if platform not in (0, 3) or (platform == 3 and encoding not in (1, 10)):
            continue
        sub = at + offset
        kind = struct.unpack_from(">H", data, sub)[0]
        if kind == 12:
            for g in range(struct.unpack_from(">I", data, sub + 12)[0]):
                first, last, glyph = struct.unpack_from(">3I", data, sub + 16 + 12 * g)
                out |= {first + i: glyph + i for i in range(last - first + 1) if glyph + i}
        elif kind == 4:
            n = struct.unpack_from(">H", data, sub + 6)[0] // 2
            ends, starts, deltas, jumps = (np.frombuffer(data, ">u2", n, sub + 14 + 2 * n * i + (2 if i else 0)).astype(int).tolist() for i in range(4))
            for i, (first, last, delta, jump) in enumerate(zip(starts, ends, deltas, jumps, strict=True)):
                for c in range(first, min(last, 0xFFFE) + 1):
                    glyph = struct.unpack_from(">H", data, sub + 16 + 6 * n + 2 * i + jump + 2 * (c - first))[0] if jump else c
                    if (glyph or not jump) and (glyph + delta) % 65536:
                        out.setdefault(c, (glyph + delta) % 65536)
    return out


def _contours(face: Face, glyph: int, depth: int) -> list[np.ndarray]:
    raw = face.outlines[glyph] if 0 <= glyph < len(face.outlines) else b""
    if not raw or depth > 8:
        return []
    n = struct.unpack_from(">h", raw)[0]
    if n < 0:
        return _composed(face, raw, depth)
    ends = list(struct.unpack_from(f">{n}H", raw, 10))
    at = 10 + 2 * n
    at += 2 + struct.unpack_from(">H", raw, at)[0]
    flags: list[int] = []
    while len(flags) <= (ends[-1] if ends else -1):
        f = raw[at]
        at += 1
        flags += [f] * (1 + (raw[at] if f & 8 else 0))
        at += bool(f & 8)
    axes = []
    for short, same in ((2, 16), (4, 32)):
        v, values = 0, []
        for f in flags:
            if f & short:
                v += raw[at] if f & same else -raw[at]
                at += 1
            elif not f & same:
                v += struct.unpack_from(">h", raw, at)[0]
                at += 2
            values.append(v)
        axes.append(values)
    out, begin = [], 0
    for end in ends:
        pts = [(x, y, f & 1) for x, y, f in zip(axes[0][begin : end + 1], axes[1][begin : end + 1], flags[begin : end + 1], strict=True)]
        begin = end + 1
        if len(pts) > 1:
            out.append(_straightened(pts))
    return out


def _straightened(pts: list[tuple[int, int, int]]) -> np.ndarray:
    full: list[tuple[float, float, int]] = []
    for (x0, y0, on0), (x1, y1, on1) in zip(pts, pts[1:] + pts[:1], strict=True):
        full.append((x0, y0, on0))
        if not on0 and not on1:
            full.append(((x0 + x1) / 2, (y0 + y1) / 2, 1))
    first = next(i for i, p in enumerate(full) if p[2])
    full = full[first:] + full[:first]
    line: list[tuple[float, float]] = []
    for i, (x, y, on) in enumerate(full):
        if on:
            line.append((x, y))
            continue
        (ax, ay, _), (bx, by, _) = full[i - 1], full[(i + 1) % len(full)]
        line += [((1 - t) ** 2 * ax + 2 * t * (1 - t) * x + t * t * bx, (1 - t) ** 2 * ay + 2 * t * (1 - t) * y + t * t * by) for t in (0.25, 0.5, 0.75)]
    return np.array(line)


def _composed(face: Face, raw: bytes, depth: int) -> list[np.ndarray]:
    out, at, more = [], 10, True
    while more:
        flags, part = struct.unpack_from(">HH", raw, at)
        at += 4
        dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", raw, at)
        at += 4 if flags & 1 else 2
        m = np.eye(2)
        if flags & 8:
            m *= struct.unpack_from(">h", raw, at)[0] / 16384
            at += 2
        elif flags & 0x40:
            m = np.diag(np.array(struct.unpack_from(">hh", raw, at)) / 16384)
            at += 4
        elif flags & 0x80:
            m = np.array(struct.unpack_from(">4h", raw, at)).reshape(2, 2) / 16384
            at += 8
        out += [c @ m + ((dx, dy) if flags & 2 else (0, 0)) for c in _contours(face, part, depth + 1)]
        more = bool(flags & 0x20)
    return out


def by_character(text: str, face: Face) -> list[tuple[str, list[tuple[int, float, float, float]]]]:
    """The built-in shaper: clusters of the script, a glyph for each character; none where the face has none."""
    return [(c, [(face.glyph_of.get(ord(ch), 0), 0.0, 0.0, float(face.advances[face.glyph_of.get(ord(ch), 0)])) for ch in c]) for c in re.findall(T.CLUSTER, text)]


def line_width(text: str, face: Face, size: float, shaper: Shaper = by_character) -> float:
    return sum(g[3] for _, glyphs in shaper(text, face) for g in glyphs) * size / face.em


def glyph_bitmap(polygons: list[np.ndarray], left: int, top: int, width: int, height: int) -> np.ndarray:
    """Coverage (0 to 255) of polygons, y downwards, in a window of pixels; the winding rule is non-zero."""
    turns = np.zeros((height * SAMPLES, width * SAMPLES + 1), dtype=np.int32)
    for p in polygons:
        q = (p - (left, top)) * SAMPLES
        for (x0, y0), (x1, y1) in zip(q, np.roll(q, -1, axis=0), strict=True):
            if y0 == y1:
                continue
            way = 1 if y1 > y0 else -1
            low, high = (y0, y1) if y1 > y0 else (y1, y0)
            rows = np.arange(max(0, int(np.ceil(low - 0.5))), min(len(turns), int(np.ceil(high - 0.5))))
            x = x0 + (rows + 0.5 - y0) * (x1 - x0) / (y1 - y0)
            np.add.at(turns, (rows, np.clip(np.ceil(x - 0.5), 0, width * SAMPLES).astype(int)), way)
    ink = (np.cumsum(turns, axis=1)[:, :-1] != 0).reshape(height, SAMPLES, width, SAMPLES)
    return np.rint(ink.mean(axis=(1, 3)) * 255).astype(np.uint8)


def emboldened(ink: np.ndarray) -> np.ndarray:
    """Ink grown by a pixel to the four sides."""
    wide = np.pad(ink, 1)
    return np.maximum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])


def shape_line(text: str, face: Face, size: float, bold: bool = False, slant: float = 0.0, shaper: Shaper = by_character) -> tuple[np.ndarray, list[Cluster], int]:
    """(ink, clusters with the boxes of their ink, baseline) of one line. A cluster without ink has the box of
    its advance, of no height; a faux bold grows the ink after boxes are taken."""
    scale, pen, drawn = size / face.em, 0.0, []
    for cluster, glyphs in shaper(text, face):
        begin, own = pen, []
        for glyph, dx, dy, advance in glyphs:
            for c in face.contours(glyph):
                p = c * scale
                own.append(np.stack([p[:, 0] + slant * p[:, 1] + pen + dx * scale, -(p[:, 1] + dy * scale)], axis=1))
            pen += advance * scale
        drawn.append((cluster, own, begin, pen))
    edge = [p for _, own, _, _ in drawn for p in own]
    top = min([-face.ascent * scale, *(p[:, 1].min() for p in edge)])
    low = max([-face.descent * scale, *(p[:, 1].max() for p in edge)])
    left, right = min([0.0, *(p[:, 0].min() for p in edge)]), max([pen, *(p[:, 0].max() for p in edge)])
    x0, y0 = int(np.floor(left)), int(np.floor(top))
    w, h = max(1, int(np.ceil(right)) - x0), max(1, int(np.ceil(low)) - y0)
    sheet, clusters = np.zeros((h, w), dtype=np.uint8), []
    for cluster, own, begin, end in drawn:
        if own:
            ink = glyph_bitmap(own, x0, y0, w, h)
            ys, xs = np.nonzero(ink)
            np.maximum(sheet, ink, out=sheet)
        if not own or not len(xs):
            clusters.append((cluster, (round(begin) - x0, -y0, round(end) - x0, -y0)))
            continue
        clusters.append((cluster, (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)))
    return (emboldened(sheet) if bold else sheet), clusters, -y0


def tokens(text: str) -> list[str]:
    """What a line may be broken after: runs without space, with the space after them."""
    return re.findall(r"\S+\s?|\s", text)


def wrapped(text: str, width: float, measure: Callable[[str], float], tokenise: Callable[[str], list[str]] = tokens) -> list[str]:
    """Greedy lines of at most ``width``; the space at a break stays on its line and is not measured; a longer
    token has a line of its own."""
    lines: list[str] = []
    for t in tokenise(text):
        if lines and measure((lines[-1] + t).rstrip()) <= width:
            lines[-1] += t
        else:
            lines.append(t)
    return lines


def fit_lines(text: str, face: Face, width: int, height: int, start: int, least: int = SMALLEST, shaper: Shaper = by_character) -> tuple[int, list[str]]:
    """The largest size from ``start`` down whose lines fit the height and then the width, or ``least``."""
    for size in range(max(start, least), least - 1, -1):
        measure = lambda s, size=size: line_width(s, face, size, shaper)
        lines = wrapped(text, width, measure)
        if (len(lines) * LINE * size <= height and all(measure(x.rstrip()) <= width for x in lines)) or size == least:
            return size, lines
    return least, wrapped(text, width, lambda s: line_width(s, face, least, shaper))


def render_block(text: str, face: Face, width: int, height: int, start: int, least: int = SMALLEST, bold: bool = False, slant: float = 0.0, centred: bool = False, shaper: Shaper = by_character) -> tuple[np.ndarray, list[Cluster], int] | None:
    """(ink, clusters, size) of a text wrapped and fitted into a box; its width is the box's, its height that of
    the ink. A blank text has none."""
    if not text.strip():
        return None
    size, lines = fit_lines(text.strip(), face, width, height, start, least, shaper)
    drawn = [shape_line(x.rstrip(), face, size, bold, slant, shaper) for x in lines]
    tops = [round(k * LINE * size) for k in range(len(drawn))]
    sheet = np.zeros((max(y + i.shape[0] for y, (i, _, _) in zip(tops, drawn, strict=True)), width), dtype=np.uint8)
    clusters: list[Cluster] = []
    for y, (ink, own, _) in zip(tops, drawn, strict=True):
        x = max(0, (width - ink.shape[1]) // 2) if centred else 0
        part = sheet[y : y + ink.shape[0], x : x + ink.shape[1]]
        np.maximum(part, ink[:, : part.shape[1]], out=part)
        clusters += [(t, (b[0] + x, b[1] + y, b[2] + x, b[3] + y)) for t, b in own]
    return *cropped(sheet, clusters), size


def cropped(ink: np.ndarray, clusters: list[Cluster]) -> tuple[np.ndarray, list[Cluster]]:
    """Without the rows above and below all ink; the width stays."""
    rows = np.flatnonzero(ink.any(axis=1))
    if not len(rows):
        return ink, clusters
    top, low = int(rows[0]), int(rows[-1]) + 1
    return ink[top:low], [(t, (b[0], b[1] - top, b[2], b[3] - top)) for t, b in clusters]


def proportions(face: Face, chars: Sequence[str], base: str = "ก") -> dict[str, float]:
    """Heights of characters' ink as shares of the base's, within the limits of their bands."""

    def tall(ch: str) -> float:
        pts = face.contours(face.glyph_of.get(ord(ch), 0)) if face.has(ch) else []
        return float(np.ptp(np.concatenate(pts)[:, 1])) if pts else 0.0

    usual = tall(base) or 0.72 * face.em
    limits = lambda ch: (0.2, 2.4) if ch in T.ABOVE + T.BELOW else (0.5, 2.4)
    return {ch: min(max(tall(ch) / usual, limits(ch)[0]), limits(ch)[1]) for ch in chars if tall(ch)}


# -- the same over a metrics table, as columns ---------------------------------------------------


def metrics(face: Face) -> list[tuple[str, int]]:
    """(char, advance) in units of the em."""
    return [(chr(c), int(face.advances[g])) for c, g in sorted(face.glyph_of.items()) if g < len(face.advances)]


def checked(table: DataFrame) -> DataFrame:
    """A metrics table (char, advance), broadcast after a check of its size."""
    n = table.limit(MOST_CHARS + 1).count()
    if n > MOST_CHARS:
        raise ValueError(f"a metrics table of more than {MOST_CHARS} characters")
    return F.broadcast(table.groupBy("char").agg(F.min("advance").alias("advance")))


def measured(tokens: DataFrame, table: DataFrame, fallback: int, *by: str) -> DataFrame:
    """(by, advance, kept): the advance of each token's characters in units of the em, and without the spaces
    that end it. Characters that the table lacks have ``fallback``."""
    chars = tokens.select(*by, F.length(F.rtrim("token")).alias("__n"), F.posexplode(F.split("token", "")).alias("__at", "char")).where("char <> ''")
    found = chars.join(checked(table), "char", "left").withColumn("w", F.coalesce("advance", F.lit(fallback)).cast("long"))
    return found.groupBy(*by).agg(F.sum("w").alias("advance"), F.coalesce(F.sum(F.when(F.col("__at") < F.col("__n"), F.col("w"))), F.lit(0)).alias("kept"))


def token_widths(lines: DataFrame, table: DataFrame, fallback: int, *by: str) -> DataFrame:
    """(by, tokens): the (advance, kept) of each token of a line (column ``line``), as ``tokens`` and ``measured`` make
    them. Lines are shuffled as texts, once; lines of equal ``by`` are added up token by token; one without
    characters is left out."""
    checked(table)  # of a bounded size, so the driver can hold it
    known = [(r.char, r.advance) for r in table.groupBy("char").agg(F.min("advance").alias("advance")).collect() if r.char and len(r.char) == 1 and r.advance is not None]

    def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(max(len(a), len(b)), dtype=np.int64)
        out[: len(a)] += a
        out[: len(b)] += b
        return out

    def widths(texts: list[str], wide: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(t) for t in texts])
        last = (code == 32) | ((code >= 9) & (code <= 13))  # a token ends with its space or with the line
        last[ends[ends > 0] - 1] = True
        at = np.flatnonzero(last)
        advance = np.diff(np.cumsum(wide[code])[at], prepend=0)
        kept = advance - np.where(code[at] == 32, wide[32], 0)
        cuts = np.searchsorted(at, ends)
        return zip(np.split(advance, cuts[:-1]), np.split(kept, cuts[:-1]), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.full(0x110000, fallback, dtype=np.int64)
        for ch, advance in known:
            wide[ord(ch)] = advance
        held, done, types = None, [], []

        def whole() -> pa.RecordBatch:
            keys = [pa.array([d[0][i] for d in done], t) for i, t in enumerate(types)]
            ends = pa.array(np.cumsum([0, *(len(d[1]) for d in done)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([d[i] for d in done])) if done else pa.array([], pa.list_(pa.int64())) for i in (1, 2)]
            done.clear()
            return pa.record_batch([*keys, *lists], names=[*by, "advance", "kept"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                keys = zip(*(part.column(c).to_pylist() for c in by), strict=True)
                for key, (advance, kept) in zip(keys, widths(part.column("line").to_pylist(), wide), strict=True):
                    if held and held[0] == key:
                        held = key, added(held[1], advance), added(held[2], kept)
                    else:
                        done += [held] if held else []
                        held = key, advance, kept
                yield whole()
        if held:
            done.append(held)
            yield whole()

    kinds = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in by)
    placed = lines.where("line <> ''").select(*by, "line").repartition(*by).sortWithinPartitions(*by)
    return placed.mapInArrow(run, f"{kinds}, advance array<bigint>, kept array<bigint>").select(*by, F.arrays_zip("advance", "kept").alias("tokens"))


def wrap_lines(tokens: Column, width: Column) -> Column:
    """The line of each token (an array of (advance, kept) structs in their order), filled greedily."""
    start = F.struct(F.lit(0).alias("line"), F.lit(0).cast("long").alias("pen"), F.array().cast("array<int>").alias("lines"))

    def add(acc: Column, t: Column) -> Column:
        fits = (F.size(acc["lines"]) > 0) & (acc["pen"] + t["kept"] <= width)
        line = F.when(fits | (F.size(acc["lines"]) == 0), acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(line.alias("line"), (F.when(fits, acc["pen"]).otherwise(F.lit(0).cast("long")) + t["advance"]).alias("pen"), F.array_append(acc["lines"], line).alias("lines"))

    return F.aggregate(tokens, start, add)["lines"]


def placed(spans: DataFrame, table: DataFrame, fallback: int, *by: str) -> DataFrame:
    """(by, start, cluster, x1, x2): where the pen is before and after each cluster of a line, in units of the em.
    ``spans`` has (by, start, cluster); marks that a table gives no advance stay on their base."""
    chars = spans.select(*by, "start", "cluster", F.explode(F.split("cluster", "")).alias("char")).where("char <> ''")
    wide = chars.join(checked(table), "char", "left").groupBy(*by, "start", "cluster").agg(F.sum(F.coalesce("advance", F.lit(fallback)).cast("long")).alias("w"))
    end = F.sum("w").over(Window.partitionBy(*by).orderBy("start"))
    return wide.select(*by, "start", "cluster", (end - F.col("w")).alias("x1"), end.alias("x2"))
