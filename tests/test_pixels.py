"""Pixel kernels against plain loops, and operators over tables of pages."""

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagemill.operators import pixels as P
from pagemill.sources import columnar, images


def page(h=60, w=120, paper=(240, 240, 235), ink=(20, 30, 90)):
    p = np.full((h, w, 3), paper, dtype=np.uint8)
    for x in range(14, 100, 6):
        p[20:32, x : x + 2] = ink
    return p


def table(spark, pages):
    return spark.createDataFrame([(k, None, None, None) if p is None else (k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in pages], P.IMAGE)


REGIONS = "page_id string, region_idx long, x1 int, y1 int, x2 int, y2 int, text string, category string, ink_height double"


def test_ink_height():
    g = P.luminance(page())
    assert P.ink_height(g) == 12 and P.ink_height(g[:10]) == 10 and P.ink_height(g[:0]) == 0
    assert P.ink_height(g[31:40]) == 9  # a single row of ink


def test_mask_is_the_local_threshold():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (17, 23), dtype=np.uint8)
    size, sigma = 17, 0.3 * (8 - 1) + 0.8
    k = np.exp(-((np.arange(size) - 8) ** 2) / (2 * sigma**2))
    k = np.outer(k, k) / k.sum() ** 2
    wide = np.pad(g.astype(float), 8, mode="edge")
    mean = np.array([[np.rint((wide[y : y + size, x : x + size] * k).sum()) for x in range(23)] for y in range(17)])
    dark = bool(np.median(g) >= 110)
    ink = g <= mean - 10 if dark else g > mean - 10
    want = np.array([[ink[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for x in range(23)] for y in range(17)])
    got, was_dark = P.ink_mask(g)
    assert was_dark == dark and (got != want).sum() <= 10  # a mean that falls on a half may round either way


def test_erase_flat_light_on_dark_and_gradient():
    clean, colour = P.erase(page())
    assert colour == (20, 30, 90) and (clean == (240, 240, 235)).all()
    clean, colour = P.erase(page(paper=(20, 20, 40), ink=(250, 240, 200)))
    assert colour == (250, 240, 200) and (clean == (20, 20, 40)).all()
    slope = np.repeat(np.linspace(150, 250, 120)[None, :, None], 60, 0).repeat(3, 2).astype(np.uint8)
    inked = slope.copy()
    inked[page()[..., 0] == 20] = 10
    clean, _ = P.erase(inked)
    assert np.abs(clean.astype(int) - slope).max() <= 6


def test_inpaint_keeps_known_pixels_and_ends():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 256, (9, 11, 3), dtype=np.uint8)
    mask = rng.random((9, 11)) < 0.6
    out = P.inpaint(p, mask)
    assert (out[~mask] == p[~mask]).all()
    assert (P.inpaint(p, np.ones((9, 11), bool)) == p).all() and (P.inpaint(p, np.zeros((9, 11), bool)) == p).all()
    flat = np.full((9, 11, 3), 77, np.uint8)
    assert (P.inpaint(flat, mask) == 77).all()
    assert P.inpaint(p[:1], mask[:1] & (np.arange(11) > 0)).shape == (1, 11, 3)


def test_composite_is_cut_at_the_edges():
    rng = np.random.default_rng(3)
    canvas, ink = rng.integers(0, 256, (8, 9, 3), dtype=np.uint8), rng.integers(0, 256, (5, 6, 4), dtype=np.uint8)
    for x, y in ((0, 0), (-3, 2), (6, 6), (-9, 0), (20, 1), (2, -4)):
        got, want = canvas.copy(), canvas.copy()
        P.composite(got, ink, x, y)
        for j in range(5):
            for i in range(6):
                if 0 <= y + j < 8 and 0 <= x + i < 9:
                    a = int(ink[j, i, 3])
                    want[y + j, x + i] = [(int(ink[j, i, c]) * a + int(canvas[y + j, x + i, c]) * (255 - a) + 127) // 255 for c in range(3)]
        assert (got == want).all()


def test_erased_measured_kept(spark):
    pages = table(spark, [("a", page()), ("b", page(paper=(20, 20, 40), ink=(250, 240, 200))), ("n", None), ("none", page())])
    rows = [("a", 1, 5, 15, 110, 40, "t", "Text", 0.0), ("a", 0, 300, 5, 400, 9, "t", "Text", None), ("b", 0, -5, 10, 500, 45, "t", "Text", 7.0), ("n", 0, 0, 0, 5, 5, "t", "Text", 0.0)]
    regions = spark.createDataFrame(rows, REGIONS)
    got = {r.page_id: r for r in P.erased(pages, regions).collect()}
    assert (P.pixels(got["a"].width, got["a"].height, got["a"].rgb) == (240, 240, 235)).all()
    assert [tuple(c) for c in got["a"].colours] == [(0, 0, 0), (20, 30, 90)] and [tuple(c) for c in got["b"].colours] == [(250, 240, 200)]
    assert got["n"].rgb is None and got["none"].colours == [] and bytes(got["none"].rgb) == page().tobytes()
    heights = {(r.page_id, r.region_idx): r.ink_height for r in P.measured(pages, regions).collect()}
    assert heights == {("a", 1): 12.0, ("a", 0): 0.0, ("b", 0): 7.0, ("n", 0): 0.0}
    assert {r.page_id: [tuple(c) for c in r.colours] for r in P.kept(pages, regions).collect()}["a"] == [(0, 0, 0)] * 2
    assert P.erased(pages.limit(0), regions).count() == 0


def test_downscaled(spark):
    big = np.random.default_rng(4).integers(0, 256, (40, 100, 3), dtype=np.uint8)
    got = {r.page_id: r for r in P.downscaled(table(spark, [("a", big), ("b", page()), ("n", None)]), 50).collect()}
    assert (got["a"].width, got["a"].height) == (50, 20) and (got["b"].width, got["b"].height) == (50, 25) and got["n"].rgb is None
    want = np.rint(big.reshape(20, 2, 50, 2, 3).mean(axis=(1, 3)))
    assert np.abs(P.pixels(50, 20, got["a"].rgb) - want).max() <= 1


def unpng(data):
    body, at, out = b"", 8, io.BytesIO(data).getvalue()
    while at < len(out):
        n, kind = struct.unpack(">I4s", out[at : at + 8])
        part = out[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h = struct.unpack(">II", part[:8])
        body += part if kind == b"IDAT" else b""
        at += n + 12
    rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, -1)
    return rows[:, 1:].cumsum(axis=0, dtype=np.uint8).reshape(h, w, -1)


def test_images_round_trip(spark, tmp_path):
    pages = {"a": page(), "b/ü x": np.random.default_rng(5).integers(0, 256, (7, 5, 3), dtype=np.uint8)}
    assert all((unpng(images.png(p)) == p).all() for p in pages.values())
    out = tmp_path / "out"
    files = images.write_images(table(spark, [*pages.items(), ("a", page()), ("n", None)]), f"file://{out}")
    assert sorted(r.file for r in files.collect()) == ["a.png", "b%2F%C3%BC%20x.png"]
    (out / "broken.png").write_bytes(b"no image")
    found = images.scan_images(spark, str(out))
    assert found.count() == 2  # decoded by Spark
    wanted = spark.createDataFrame([("a", "./a.png")], "page_id string, image string")
    row = images.page_images(wanted, found, str(out)).first()
    assert bytes(row.rgb) == page().tobytes() and row.width == 120
    with pytest.raises(Exception, match="no image"):
        images.page_images(spark.createDataFrame([("q", "q.png")], "page_id string, image string"), found, str(out)).collect()


def test_previews(spark):
    rows = table(spark, [(k, page()) for k in "abc"])
    regions = spark.createDataFrame([("a", 0, 5, 15, 110, 400, "t", "Text", 0.0)], REGIONS)
    got = images.previews(rows.where("page_id <> 'b'"), rows, regions, 2).orderBy("page_id").collect()
    assert [(r.page_id, r.width, r.height) for r in got] == [("a", 252, 60), ("b", 120, 60)]
    sheet = P.pixels(252, 60, got[0].rgb)
    assert (sheet[:, 120:132] == 245).all() and (sheet[15, 132 + 5] == (220, 40, 40)).all() and (sheet[:, :120] == page()).all()


def test_columnar_pages(spark):
    schema = "index long, page_hash string, width int, height int, texts array<string>, boxes array<array<double>>, categories array<int>, doc_category string, page_no int"
    box = [-3.5, 2.9, 30.2, 400.0]
    rows = [(0, "0123456789abcdefgh", 20, 50, ["x", " ", "p", None], [box] * 4, [1, 1, 0, 1], "law", 3), (1, None, 9, 9, None, None, None, None, None), (2, "h", 9, 9, ["x"], [], [1], "a", 1)]
    df = spark.createDataFrame(rows, schema)
    got = columnar.columnar_pages(df, ["Picture", "Text"], "corpus", limit=2).orderBy("index").collect()
    assert [r.page_id for r in got] == ["0123456789abcdef", "1"] and got[1].regions == []
    assert [tuple(r) for r in got[0].regions] == [(0, 2, 20, 50, "x", "Text", 0.0)] and got[0].meta["doc_category"] == "law"
    with pytest.raises(Exception, match="different lengths"):
        columnar.columnar_pages(df, ["Picture", "Text"], "corpus", skip=2).collect()


def test_pages_come_in_slices(spark):
    """A worker holds the values of few pages of an Arrow batch at a time, and gives all of them back."""
    side, n = 200, 3 * P.SLICE // (200 * 200 * 3)
    pages = [bytes([k % 251]) * (side * side * 3) for k in range(n)]
    batch = (pa.array([side] * n), pa.array([side] * n), pa.array(pages, pa.binary()), pa.nulls(n))
    out = list(P.sliced("binary", lambda w, h, p, b: p).func(iter([batch])))
    assert len(out) > 2 and max(o.nbytes for o in out) < 1.1 * P.SLICE
    assert [p for o in out for p in o.to_pylist()] == pages
