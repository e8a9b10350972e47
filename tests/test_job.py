"""Glyph banks, drawing, and the command line over a small corpus."""

import json
import random

import numpy as np
import pytest

from pagemill import __main__ as cli
from pagemill.operators import glyphs as G
from pagemill.sources.images import png


def shape(h, w):
    p = np.full((h, w, 3), 255, dtype=np.uint8)
    p[1:-1, 1:-1] = 0
    return p


@pytest.fixture(scope="module")
def bank_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("bank")
    for char, (h, w) in {"ก": (40, 30), "น": (40, 34), "า": (38, 20), "◌้": (12, 14), "◌ุ": (11, 10), "2": (36, 22)}.items():
        (root / char).mkdir()
        for k in range(2):
            (root / char / f"{k:03}.png").write_bytes(png(shape(h, w + 2 * k)))
    return str(root)


def test_bank(spark, bank_dir):
    rows = {(r.char, r.inst): r for r in G.scan_bank(spark, bank_dir).collect()}
    assert {c for c, _ in rows} == set("กนา2ุ้") and len(rows) == 12
    r = rows["้", 1]
    assert (r.height, r.width) == (12, 16) and r.text_height == pytest.approx(12 / 0.45) and r.ink[0] == 0 and max(r.ink) == 255
    with pytest.raises(ValueError, match="empty"):
        G.loaded(G.scan_bank(spark, bank_dir).limit(0))


def test_stitch_places_bands(spark, bank_dir):
    bank = G.loaded(G.scan_bank(spark, bank_dir))
    ink, clusters = G.stitch("กุ้ น", bank, 20, random.Random(1))
    assert [t for t, _ in clusters] == ["กุ้ ", "น"]
    (_, first), (_, second) = clusters
    assert first[1] < second[1] and first[3] > second[3] and first[2] < second[0]  # marks above and below the base
    for _, (x1, y1, x2, y2) in clusters:
        assert ink[y1:y2, x1:x2].any() and 0 <= x1 < x2 <= ink.shape[1] and 0 <= y1 < y2 <= ink.shape[0]
    assert G.stitch("xyz", bank, 20, random.Random(1))[1] == [] and G.coverage("กx", bank) == 0.5
    small, _, size = G.block("กา " * 40, bank, 120, 60, 40, random.Random(1))
    assert size < 40
    again = G.block("กา " * 40, bank, 120, 60, 40, random.Random(1))[0]
    assert (small == again).all()


def test_run(spark, bank_dir, tmp_path, capsys):
    corpus, out = tmp_path / "in", tmp_path / "out"
    corpus.mkdir()
    paper = np.full((120, 300, 3), 240, dtype=np.uint8)
    for x in range(20, 200, 6):
        paper[30:42, x : x + 2] = (10, 20, 120)
    lines = []
    for name in ("a", "b c"):
        (corpus / f"{name}.png").write_bytes(png(paper))
        regions = [{"box": [10, 22, 260, 52], "text": "กาน้ำ นา" if name == "a" else "unknown"}, {"box": [10, 80, 200, 100], "text": "2", "category": "Picture"}]
        lines.append(json.dumps({"id": name, "image": f"{name}.png", "regions": regions}))
    (corpus / "annotations.jsonl").write_text("\n".join(lines))
    session = spark
    args = cli.parser().parse_args(["run", "--input", str(corpus), "--out", str(out), "--glyph-bank", bank_dir, "--boxes", "--no-locale"])
    assert cli.run(session, args) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["pages"] == 2 and report["regions"] == 2 and report["fitted"] == 2
    assert sorted(p.name for p in (out / "images").glob("*.png")) == ["a.png", "b%20c.png"]
    labels = {r.page_id: r for r in spark.read.parquet(f"{out}/_labels").collect()}
    assert labels["a"].size > 0 and labels["a"].clusters and labels["b c"].size == 0 and not labels["b c"].clusters
    for c in labels["a"].clusters:
        assert 10 <= c.box.x1 < c.box.x2 <= 262 and 20 <= c.box.y1 < c.box.y2 <= 54
    canvas = {r.page_id: np.frombuffer(r.rgb, np.uint8).reshape(120, 300, 3) for r in spark.read.parquet(f"{out}/_canvases").collect()}
    assert (canvas["b c"] == 240).all() and (canvas["a"] == (10, 20, 120)).all(axis=2).any()
    args = cli.parser().parse_args(["run", "--input", str(corpus), "--out", str(tmp_path / "rejected"), "--glyph-bank", bank_dir, "--min-fit-rate", "1.1", "--previews", "0"])
    assert cli.run(session, args) == 1
    assert cli.main(["list"]) == 0 and "adaptive, none" in capsys.readouterr().out
