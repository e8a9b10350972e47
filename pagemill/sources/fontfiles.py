"""Font files: names, style and code points read from their tables; the manifest of a bank."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.fonts import THAI
from pagemill.operators.typeface import glyph_map

# Style names by weight; the longest name found decides.
WEIGHTS = {"thin": 100, "extralight": 200, "ultralight": 200, "light": 300, "regular": 400, "medium": 500, "semibold": 600, "demibold": 600, "bold": 700, "extrabold": 800, "ultrabold": 800, "black": 900, "heavy": 900}
CATEGORY = "sans"
#: The code points that faces are checked for.
REQUIRED = THAI
_FACE = "face_index int, family string, style string, italic boolean, code_points array<int>"


def _name(names: dict[int, str], *ids: int) -> str:
    return next((names[i] for i in ids if names.get(i)), "")


def _names(data: bytes, at: int) -> dict[int, str]:
    """Names by id; those of Windows in English before others."""
    n, texts = struct.unpack_from(">HH", data, at + 2)
    found: dict[int, tuple[int, str]] = {}
    for k in range(n):
        platform, _, language, kind, size, offset = struct.unpack_from(">6H", data, at + 6 + 12 * k)
        raw = data[at + texts + offset : at + texts + offset + size]
        text = raw.decode("latin-1" if platform == 1 else "utf-16-be", "replace").strip()
        rank = (platform == 3) + (language == 0x409)
        if text and rank > found.get(kind, (-1, ""))[0]:
            found[kind] = rank, text
    return {k: v for k, (_, v) in found.items()}


def faces(data: bytes) -> list[dict]:
    """The faces of a file; none if it is no font or is broken."""
    try:
        starts = [0]
        if data[:4] == b"ttcf":
            starts = list(struct.unpack_from(f">{struct.unpack_from('>I', data, 8)[0]}I", data, 12))
        elif data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
            return []
        out = []
        for k, start in enumerate(starts):
            n = struct.unpack_from(">H", data, start + 4)[0]
            at = {data[p : p + 4]: struct.unpack_from(">I", data, p + 8)[0] for p in range(start + 12, start + 12 + 16 * n, 16)}
            names = _names(data, at[b"name"])
            style = _name(names, 17, 2)
            slanted = bool(b"OS/2" in at and struct.unpack_from(">H", data, at[b"OS/2"] + 62)[0] & 1)
            out.append({"face_index": k, "family": _name(names, 16, 1), "style": style, "italic": slanted or "italic" in style.lower() or "oblique" in style.lower(), "code_points": sorted(glyph_map(data, at[b"cmap"]))})
        return out
    except (struct.error, KeyError, ValueError):
        return []


def weight_of(style: Column, stem: Column) -> Column:
    """By the longest style name, else by three digits that end the file's stem, else 400."""
    token = F.regexp_replace(F.lower(style), "[^a-z]", "")
    named = F.coalesce(*[F.when(token.contains(t), WEIGHTS[t]) for t in sorted(WEIGHTS, key=lambda t: (-len(t), t))])
    digits = F.regexp_extract(stem, r"-(\d{3})i?$", 1)
    return F.coalesce(named, F.when(digits != "", digits.cast("int")), F.lit(400))


def scan_fonts(spark: SparkSession, root: str, license_note: str = "", required: Iterable[int] = REQUIRED) -> DataFrame:
    """(path, face_index, family, category, weight, italic, license, missing) of the .ttf, .otf and .ttc
    files under ``root``; a file that cannot be read has no row. The category is the first folder, and
    ``missing`` the required code points that a face has no glyph for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ttf,otf,ttc,TTF,OTF,TTC}").load(root)

    @F.pandas_udf(f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _FACE.split(', '))}>>")
    def read(content: pd.Series) -> pd.Series:
        return content.map(faces)

    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    rows = files.select(path.alias("path"), F.explode(read("content")).alias("f")).select("path", "f.*")
    folders = F.split("path", "/")
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    category = F.when(F.size(folders) > 1, folders[0]).otherwise(CATEGORY)
    wanted = F.array(*[F.lit(c) for c in sorted(required)]).cast("array<int>")
    return rows.select("path", "face_index", "family", category.alias("category"), weight_of(F.col("style"), stem).alias("weight"), "italic", F.lit(license_note).alias("license"), F.array_except(wanted, "code_points").alias("missing"))


def font_files(spark: SparkSession, root: str, most_bytes: int = 64 << 20) -> dict[str, bytes]:
    """The font files under ``root`` by path below it, after a check of their size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ttf,otf,ttc,TTF,OTF,TTC}").load(root)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"font files of {size} bytes; at most {most_bytes} are loaded")
    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return {r.path.split(base, 1)[-1]: bytes(r.content) for r in files.select("path", "content").orderBy("path").collect()}


def write_manifest(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, rare: Iterable[int] = (), strict: bool = False) -> DataFrame:
    """The faces of a manifest that have every required code point, rare ones aside unless ``strict``."""
    found = spark.read.schema("path string, face_index int, family string, category string, weight int, italic boolean, license string, missing array<int>").json(path)
    spared = F.array(*[F.lit(c) for c in ([] if strict else sorted(rare))]).cast("array<int>")
    return found.where(F.size(F.array_except(F.coalesce("missing", F.array().cast("array<int>")), spared)) == 0)


def covers(text: Column, missing: Column) -> Column:
    """Whether a face that lacks ``missing`` can show all of ``text``; null texts are shown."""
    points = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c))
    return ~F.arrays_overlap(points, missing)
