"""Font tables built by hand, read back."""

import struct

from pagemill.sources import fontfiles as FF
from pyspark.sql import functions as F


def font(family, style, points, italic=False, kind=4):
    names = [(3, 1, 0x409, 1, family.encode("utf-16-be")), (1, 0, 0, 1, b"Mac"), (3, 1, 0x409, 2, style.encode("utf-16-be"))]
    head, texts = b"", b""
    for p, e, lang, k, raw in names:
        head += struct.pack(">6H", p, e, lang, k, len(raw), len(texts))
        texts += raw
    name = struct.pack(">HHH", 0, len(names), 6 + len(head)) + head + texts
    if kind == 12:
        sub = struct.pack(">HHIII", 12, 0, 16 + 12 * len(points), 0, len(points)) + b"".join(struct.pack(">3I", c, c, i + 1) for i, c in enumerate(points))
        cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + sub
    else:
        seg = [(c, c) for c in sorted(points)] + [(0xFFFF, 0xFFFF)]
        n = len(seg)
        ends, starts = ([s[i] for s in seg] for i in (1, 0))
        deltas = [(i + 1 - c) % 65536 for i, (c, _) in enumerate(seg)]
        deltas[0], jumps = 0, [2 * n] + [0] * (n - 1)  # the first by the glyph array
        body = struct.pack(f">{n}H", *ends) + b"\0\0" + b"".join(struct.pack(f">{n}H", *x) for x in (starts, deltas, jumps)) + struct.pack(">H", 7)
        cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">7H", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body
    tables = {b"OS/2": b"\0" * 62 + struct.pack(">H", int(italic)) + b"\0" * 32, b"cmap": cmap, b"name": name}
    out, at, data = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables), b""
    for tag, t in tables.items():
        out += tag + struct.pack(">III", 0, at + len(data), len(t))
        data += t
    return out + data


def test_faces():
    for kind in (4, 12):
        (f,) = FF.faces(font("Sara", "Bold", [0x41, 0xE01, 0xE40], kind=kind))
        assert (f["family"], f["style"], f["italic"], f["code_points"]) == ("Sara", "Bold", False, [0x41, 0xE01, 0xE40])
    assert FF.faces(font("A", "Oblique", [65]))[0]["italic"] and FF.faces(font("A", "Regular", [65], True))[0]["italic"]
    assert FF.faces(b"") == [] and FF.faces(b"no font") == [] and FF.faces(font("A", "B", [65])[:60]) == []


def test_scan_and_manifest(spark, tmp_path):
    root = tmp_path / "fonts"
    (root / "serif" / "x").mkdir(parents=True)
    (root / "serif" / "x" / "a-ExtraBold.ttf").write_bytes(font("Aa", "ExtraBold", [0xE01, 0xE02]))
    (root / "b-250i.otf").write_bytes(font("Bb", "", [0xE01], True, 12))
    (root / "broken.ttf").write_bytes(b"\0\1\0\0zz")
    (root / "note.txt").write_text("x")
    found = FF.scan_fonts(spark, str(root), "free", [0xE01, 0xE02, 0xE03])
    rows = {r.family: r for r in found.collect()}
    assert set(rows) == {"Aa", "Bb"}
    assert (rows["Aa"].path, rows["Aa"].category, rows["Aa"].weight, rows["Aa"].italic, rows["Aa"].missing) == ("serif/x/a-ExtraBold.ttf", "serif", 800, False, [0xE03])
    assert (rows["Bb"].path, rows["Bb"].category, rows["Bb"].weight, rows["Bb"].italic, rows["Bb"].missing) == ("b-250i.otf", "sans", 250, True, [0xE02, 0xE03])
    FF.write_manifest(found, str(tmp_path / "m"))
    assert [r.family for r in FF.read_manifest(spark, str(tmp_path / "m"), [0xE03]).collect()] == ["Aa"]
    assert FF.read_manifest(spark, str(tmp_path / "m"), [0xE03], strict=True).count() == 0
    shown = found.select("family", *[FF.covers(F.lit(t), F.col("missing")).alias(n) for n, t in (("a", "กข"), ("b", "ก"), ("c", ""), ("d", None))])
    assert {r.family: tuple(r)[1:] for r in shown.collect()} == {"Aa": (True, True, True, True), "Bb": (False, True, True, True)}
