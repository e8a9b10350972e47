"""Sources, records and the registry."""

import json

import pytest

from pagemill.plans.registry import Registry, UnknownComponent
from pagemill.sources import annotations, records


def test_annotations(spark, tmp_path):
    box = [1.9, 2, 30.2, 40]
    pages = [
        {"id": "a", "image": "a.png", "regions": [{"box": box, "text": " x "}, {"box": box, "text": "y", "category": "Picture"}], "lang": "th"},
        {"image": "b.png", "regions": [{"box": box, "text": None, "ink_height": 3}]},
        {"id": "c", "image": "c.png"},
    ]
    path = tmp_path / "annotations.jsonl"
    path.write_text("\n".join([json.dumps(pages[0]), "", json.dumps(pages[1]), "  ", json.dumps(pages[2])]) + "\n")
    rows = annotations.read_annotations(spark, str(path)).orderBy("line_no").collect()
    assert [r.page_id for r in rows] == ["a", "2", "c"] and [r.line_no for r in rows] == [0, 2, 4]
    assert [tuple(x) for x in rows[0].regions] == [(1, 2, 30, 40, "x", "Text", 0.0)]
    assert rows[0].meta == {"lang": "th"} and rows[1].regions[0].text == "" and rows[2].regions == []
    assert [r.page_id for r in annotations.read_annotations(spark, str(path), skip=1, limit=1).collect()] == ["2"]
    assert annotations.read_annotations(spark, str(path), limit=0).count() == 0
    assert annotations.region_rows(annotations.read_annotations(spark, str(path))).count() == 2
    with pytest.raises(FileNotFoundError):
        annotations.read_annotations(spark, str(tmp_path / "none.jsonl"))


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = annotations.numbered_lines(spark, str(path))
        assert found.rdd.getNumPartitions() > 4
        assert all(r.line.split()[1] == str(r.line_no) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dataset(spark, tmp_path):
    rows = [("p", k, 0, k, 9, 9, "Text", f"t{k}", "s", k > 0) for k in (2, 0, 1)] + [("q", 0, 0, 0, 9, 9, "Text", "t", "s", True)]
    labels = spark.createDataFrame(rows, "page_id string, region_idx long, x1 int, y1 int, x2 int, y2 int, category string, text string, source_text string, fit boolean")
    records.write_dataset(labels, str(tmp_path / "out"))
    got = {x["id"]: x for x in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/labels")).collect())}
    assert got["p"]["fit_rate"] == 0.6667 and [x["text"] for x in got["p"]["regions"]] == ["t0", "t1", "t2"]
    assert json.loads(spark.read.text(str(tmp_path / "out/info")).first().value) == {"pages": 2, "format": records.FORMAT}


def test_registry():
    made = []
    r = Registry("source")
    r.register("a", lambda x: made.append(x) or x)
    assert not made and "a" in r and list(r) == ["a"] and r.create("a", 3) == 3
    with pytest.raises(UnknownComponent, match="there are: a"):
        r.create("b")
