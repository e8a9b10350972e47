"""Typefaces, warps, renderers, transforms, settings and pages that fail."""

import json
import random
import struct

import numpy as np
import pytest

from pagemill import __main__ as cli
from pagemill.operators import fonts, render, sampling, transforms, typeface, warps
from pagemill.operators import pixels as P
from pagemill.plans import settings
from pagemill.sources import records
from pagemill.sources.images import png

EM = 1000


def square(x0, y0, x1, y1):
    """A glyph of one contour of four points."""
    pts = [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]
    dx = [b - a for a, b in zip([0, *[p[0] for p in pts]], [p[0] for p in pts])]
    dy = [b - a for a, b in zip([0, *[p[1] for p in pts]], [p[1] for p in pts])]
    body = struct.pack(">hhhhh", 1, x0, y0, x1, y1) + struct.pack(">HH", 3, 0) + bytes([1] * 4) + struct.pack(">4h", *dx) + struct.pack(">4h", *dy)
    return body + b"\0" * (-len(body) % 4)


def font(chars, advance=600, marks=()):
    """A TrueType file with a box for each character; marks have no advance."""
    glyphs = [b""] + [square(100, 700, 300, 800) if c in marks else square(50, 0, 550, 500) for c in chars]
    loca, glyf = [0], b""
    for g in glyphs:
        glyf += g
        loca.append(len(glyf))
    n = len(glyphs)
    groups = b"".join(struct.pack(">3I", ord(c), ord(c), k + 1) for k, c in sorted(enumerate(chars), key=lambda t: t[1]))
    cmap12 = struct.pack(">HHIII", 12, 0, 16 + len(groups), 0, len(chars)) + groups
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 10, 12) + cmap12,
        b"glyf": glyf,
        b"head": struct.pack(">IIIIHH", 0x10000, 0, 0, 0x5F0F3CF5, 0, EM) + b"\0" * 16 + struct.pack(">4h", 0, 0, 600, 800) + struct.pack(">HHhhh", 0, 6, 2, 1, 0),
        b"hhea": struct.pack(">Ihhh", 0x10000, 800, -200, 0) + b"\0" * 24 + struct.pack(">H", n),
        b"hmtx": b"".join(struct.pack(">Hh", 0 if k and chars[k - 1] in marks else advance, 0) for k in range(n)),
        b"loca": struct.pack(f">{n + 1}I", *loca),
        b"maxp": struct.pack(">IH", 0x10000, n) + b"\0" * 26,
        b"name": struct.pack(">HHH", 0, 0, 6),
    }
    at, head, body = 12 + 16 * len(tables), b"", b""
    for tag, data in tables.items():
        head += tag + struct.pack(">III", 0, at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0) + head + body


def test_face_and_line():
    face = typeface.Face.read(font("ab"))
    assert face.has("a") and not face.has("z") and face.missing([97, 122]) == [122]
    assert typeface.line_width("abz", face, 50) == pytest.approx(90)  # the missing glyph has an advance too
    ink, clusters, base = typeface.shape_line("ab", face, 100)
    assert [t for t, _ in clusters] == ["a", "b"] and base == 80
    (_, a), (_, b) = clusters
    assert a == (5, 30, 55, 80) and b == (65, 30, 115, 80)
    assert (ink[30:80, 5:55] == 255).all() and not ink[:30].any() and not ink[:, 56:64].any()
    slanted = typeface.shape_line("a", face, 100, slant=0.5)[0]
    assert slanted.shape[1] > 60 and slanted[31].nonzero()[0].min() > slanted[78].nonzero()[0].min()
    assert typeface.shape_line("a", face, 100, bold=True)[0].astype(int).sum() > typeface.shape_line("a", face, 100)[0].astype(int).sum()
    assert typeface.shape_line("", face, 20)[1] == []
    with pytest.raises(ValueError, match="no TrueType"):
        typeface.Face.read(b"nothing of the kind")


def test_marks_stay_on_their_base():
    face = typeface.Face.read(font("ก้", marks="้"))
    _, clusters, _ = typeface.shape_line("ก้ก", face, 100)
    assert [t for t, _ in clusters] == ["ก้", "ก"] and clusters[1][1][0] == 65
    assert typeface.proportions(face, "ก้")["ก"] == 1.0 and typeface.proportions(face, "ก้")["้"] == pytest.approx(0.2)


def test_wrap_and_fit():
    face = typeface.Face.read(font("ab "))
    measure = lambda s: typeface.line_width(s, face, 10)
    assert typeface.wrapped("aa bb aaaaaaaa b", 30, measure) == ["aa bb ", "aaaaaaaa ", "b"]
    size, lines = typeface.fit_lines("aa bb aa bb", face, 60, 60, 40)
    assert len(lines) * typeface.LINE * size <= 60 and all(typeface.line_width(x.rstrip(), face, size) <= 60 for x in lines)
    bigger = typeface.wrapped("aa bb aa bb", 60, lambda s: typeface.line_width(s, face, size + 1))
    assert len(bigger) * typeface.LINE * (size + 1) > 60 or any(typeface.line_width(x.rstrip(), face, size + 1) > 60 for x in bigger)
    assert typeface.fit_lines("a" * 400, face, 20, 20, 40)[0] == typeface.SMALLEST
    assert typeface.render_block("  ", face, 10, 10, 10) is None
    ink, clusters, _ = typeface.render_block("aa bb", face, 200, 60, 30)
    assert ink.shape[1] == 200 and ink[0].any() and ink[-1].any() and len(clusters) == 5


def test_glyph_bitmap_of_curves_and_holes():
    ring = [np.array([(1, 1), (9, 1), (9, 9), (1, 9)], float), np.array([(3, 3), (3, 7), (7, 7), (7, 3)], float)]
    ink = typeface.glyph_bitmap(ring, 0, 0, 10, 10)
    assert ink[2, 2] == 255 and ink[5, 5] == 0 and ink[0, 0] == 0
    curve = typeface._straightened([(0, 0, 1), (10, 0, 0), (10, 10, 1), (0, 10, 1)])
    assert len(curve) == 6 and curve[:, 0].max() <= 10


def test_warps_keep_clusters():
    face = typeface.Face.read(font("ab"))
    make = lambda k: typeface.render_block("abab", face, 120 * k, 40 * k, 30 * k)
    plain = make(1)
    ink, clusters, size = warps.warped(make, 0.8, random.Random(3))
    assert [t for t, _ in clusters] == list("abab") and ink.any() and abs(size - plain[2]) <= 1
    for _, (x1, y1, x2, y2) in clusters:
        assert 0 <= x1 < x2 <= ink.shape[1] and 0 <= y1 < y2 <= ink.shape[0] and ink[y1:y2, x1:x2].any()
    again = warps.warped(make, 0.8, random.Random(3))[0]
    assert (again == ink).all() and warps.warped(lambda k: None, 1.0, random.Random(1)) is None
    still = warps.warped(make, 0.0, random.Random(3))[0]
    assert np.abs(still[:, : plain[0].shape[1]].astype(int).sum() - plain[0].astype(int).sum()) < 0.15 * plain[0].astype(int).sum()
    img = np.arange(12, dtype=float).reshape(3, 4)
    gy, gx = np.mgrid[:3, :4]
    assert (warps.sampled(img, gx, gy) == img).all() and (warps.sampled(img, gx, gy, nearest=True) == img).all() and warps.sampled(img, gx + 9, gy).sum() == 0


def test_chain_and_guard():
    thai = font("ก ")
    bank = {"ก": [(np.full((20, 10), 255, dtype=np.uint8), 20.0)]}
    glyph = render.GlyphRenderer(bank)
    face = render.FontRenderer({"sans/a.ttf": font("ab ")}, [("sans/a.ttf", "A", "sans", 400, False)])
    page = render.Chain([glyph, face]).for_page(0, ["ก", "ab"])
    assert page.draw("ก", 60, 30, 20, random.Random(1))[0].any() and page.draw("ab", 60, 30, 20, random.Random(1))[1][0][0] == "a"
    assert glyph.draw("ab", 60, 30, 20, random.Random(1)) is None and page.style["glyph_bank"] == "true" and page.style["font"] == "A"
    mixed = render.GlyphRenderer(bank, face=font("ab ")).draw("กa", 60, 30, 20, random.Random(1))
    assert [t for t, _ in mixed[1]] == ["ก", "a"]
    with pytest.raises(ValueError, match="lacks"):
        render.FontRenderer({"x": thai}, [], fixed="x")
    with pytest.raises(ValueError, match="no face can show"):
        sampling.style_at(1, 1, [("p", "A", "sans", 400, False)], covers=lambda f: False)
    assert sampling.style_at(5, 3, [("p", "A", "sans", 400, False), ("q", "B", "serif", 400, False)], covers=lambda f: f[0] == "q")[0] == "q"
    ink = np.zeros((20, 30), dtype=np.uint8)
    ink[5:15, 10:30] = 255
    small, boxes = render.fit_to_box(ink, [("x", (10, 5, 30, 15))], 10, 10)
    assert small.shape == (5, 10) and boxes == [("x", (0, 0, 10, 5))]


def test_families(spark):
    bank = fonts.bank(spark)
    assert [r.family for r in fonts.families(bank, "monospace").collect()] == ["Tlwg Mono", "Tlwg Typewriter", "Tlwg Typist"]
    assert fonts.by_category(bank, "serif").count() == 5 and fonts.named(bank, "NOTO sans thai").first().weight == 400
    with pytest.raises(fonts.UnknownFamily, match="Sarabun"):
        fonts.named(bank, "Nothing")
    assert fonts.shaping_face(bank).first().category == "handwriting" and fonts.shaping_face(bank, "Kanit").first().family == "Kanit"


REGIONS = "page_id string, region_idx long, x1 int, y1 int, x2 int, y2 int, text string, category string, ink_height double"


def test_transforms(spark):
    page = np.random.default_rng(1).integers(0, 200, (30, 60, 3), dtype=np.uint8)
    images = spark.createDataFrame([("a", 60, 30, page.tobytes()), ("b", 60, 30, page.tobytes()), ("n", None, None, None)], "page_id string, width int, height int, rgb binary")
    regions = spark.createDataFrame([("a", 1, 0, 0, 60, 10, "wide", "Text", 6.0), ("a", 0, 5, 12, 25, 20, "first", "Text", 4.0)], REGIONS)
    white = {r.page_id: r.rgb for r in transforms.white_background(images, regions)[0].collect()}
    got = P.pixels(60, 30, white["a"])
    assert (got[:10] == page[:10]).all() and (got[12:20, 5:25] == page[12:20, 5:25]).all() and (got[20:] == 255).all()
    assert (P.pixels(60, 30, white["b"]) == 255).all() and white["n"] is None
    canvases, moved = transforms.stack(images, regions, margin=10, gap=4)
    rows = {r.region_idx: r for r in moved.collect()}
    assert (rows[0].x1, rows[0].y1, rows[0].x2, rows[0].y2) == (10, 10, 30, 18) and rows[0].ink_height == 4.0
    assert (rows[1].x1, rows[1].y1, rows[1].x2) == (10, 22, 50) and rows[1].ink_height == pytest.approx(4.0) and rows[1].y2 - rows[1].y1 == 7
    made = {r.page_id: r for r in canvases.collect()}
    assert made["a"].height == 10 + 12 + 14 and (P.pixels(60, 36, made["a"].rgb)[10:18, 10:30] == page[12:20, 5:25]).all()
    assert made["b"].height == 30 and bytes(made["b"].rgb) == page.tobytes()
    assert transforms.keep(images, regions) == (images, regions)


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# no\nPAGEMILL_SEED=5\nexport PAGEMILL_LLM_API_KEY='k'\nPAGEMILL_MAX_SIDE=9\n")
    s = settings.load({"max_side": 7, "fonts_dir": None}, {"PAGEMILL_SEED": "6"}, str(env))
    assert (s.seed, s.max_side, s.llm_api_key, s.fonts_dir) == (6, 7, "k", None) and s.require_key() == "k" and s.rng_seed(2) == 6 + 2 * 7919
    with pytest.raises(ValueError, match="API_KEY"):
        settings.load(environ={}, dotenv=str(tmp_path / "none")).require_key()
    assert settings.options(["a=1", "b=x", "a=[2]", "c=true"]) == {"a": [2], "b": "x", "c": True} and settings.options(None) == {}
    assert settings.fitting(lambda a, b=1: None, {"a": 1, "z": 2}) == {"a": 1} and settings.fitting(lambda **k: None, {"z": 2}) == {"z": 2}


def test_summary():
    text = records.summary({"pages": 3, "regions": 9, "empty": 1, "fit_rate": 0.5, "rejected": 1, "rejected_ids": ["r"], "failed": 2, "failed_ids": ["x", "y"]})
    assert "50.0%" in text and "x, y" in text and "rejected  1: r" in text


def test_run_with_faces_and_a_page_that_fails(spark, tmp_path, capsys):
    corpus, out, faces = tmp_path / "in", tmp_path / "out", tmp_path / "fonts"
    (faces / "sans").mkdir(parents=True)
    corpus.mkdir()
    letters = [chr(c) for c in sorted(set(fonts.REQUIRED))] + sorted(set("abAnulReport "))
    (faces / "sans" / "A-400.ttf").write_bytes(font("".join(letters)))
    paper = np.full((120, 300, 3), 240, dtype=np.uint8)
    (corpus / "a.png").write_bytes(png(paper))
    (corpus / "b.png").write_bytes(b"broken")
    pages = [{"id": "a", "image": "a.png", "lang": "th", "regions": [{"box": [10, 20, 200, 60], "text": "Annual Report"}]}, {"id": "b", "image": "b.png", "regions": [{"box": [0, 0, 9, 9], "text": "x"}]}, {"id": "c", "image": "none.png", "regions": []}]
    (corpus / "annotations.jsonl").write_text("\n".join(map(json.dumps, pages)))
    args = cli.parser().parse_args(["run", "--input", str(corpus), "--out", str(out), "--fonts-dir", str(faces), "--font", "sans/A-400.ttf", "--transform", "white-background", "--pagejson", "--previews", "1"])
    assert cli.run(spark, args) == 0
    assert "failed    2: b, c" in capsys.readouterr().err
    read = lambda kind: [json.loads(r.value) for r in spark.read.text(str(out / kind)).collect()]
    (label,) = read("labels")
    assert label["id"] == "a" and label["image"] == "images/a.png" and (label["width"], label["height"]) == (300, 120)
    assert label["meta"]["lang"] == "th" and label["meta"]["style"]["category"] == "fixed" and label["meta"]["index"] == 0
    (region,) = label["regions"]
    assert region["size"] > 0 and region["fit"] and "".join(c["text"] for c in region["clusters"]) == "Annual Report"
    assert render.outside(spark.read.parquet(str(out / "_labels"))).count() == 0
    (layout,) = read("pages")
    assert layout["layout"][0]["text"] == "Annual Report" and len(layout["layout"][0]["bbox"]) == 4
    (report,) = read("report")
    assert report["failed"] == 2 and report["config"]["transform"] == ["white-background"] and {r["page_id"] for r in read("failed")} == {"b", "c"}
    args = cli.parser().parse_args(["run", "--input", str(corpus), "--out", str(tmp_path / "o2"), "--fonts-dir", str(faces), "--no-clusters", "--no-locale", "--min-fit-rate", "0.5", "--previews", "0", "--source-opt", "limit=1"])
    assert cli.run(spark, args) == 0
    (label,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "o2" / "labels")).collect()]
    assert "clusters" not in label["regions"][0] and label["meta"]["style"]["font_file"] == "sans/A-400.ttf"
    assert cli.main(["list"]) == 0 and "chain, font, glyph" in capsys.readouterr().out
