"""Completions: asked once, cached, tried again, gated."""

import pytest

from pagemill.operators import completion as C


def test_asked_tries_again_with_waits():
    waits, left = [], [OSError, ValueError]

    def client(system, user):
        if left:
            raise left.pop()
        return " ok "

    assert C.asked(client, "s", "u", pause=waits.append) == "ok" and waits == [1.0, 2.0]

    def broken(system, user):
        raise OSError

    waits.clear()
    assert C.asked(broken, "s", "u", pause=waits.append) == "" and waits == [1.0, 2.0, 4.0]
    assert C.asked(lambda s, u: None, "s", "u") == ""


@pytest.fixture
def regions(spark):
    rows = [("a", 0, "The board resolved", "Title"), ("a", 1, "12,651", "Text"), ("a", 2, "The board resolved", "Text"), ("b", 0, None, "Text"), ("b", 1, "fails here", "Text"), ("b", 2, "long reply", "Text"), ("c", 0, "Ã Ì À > Ê", "Text")]
    return spark.createDataFrame(rows, "page_id string, region_idx long, text string, category string")


def test_translate_and_cache(spark, regions, tmp_path):
    log = tmp_path / "asked"

    def client(system, user):
        with open(log, "a") as f:
            f.write(user + "\n")
        if user == "fails here":
            raise OSError
        return '"' + user.upper() + '"' if user != "long reply" else "x" * 99

    cache = str(tmp_path / "cache")
    shown = lambda: {(r.page_id, r.region_idx): r.shown for r in C.translate(regions, client, "m", cache, "to upper", tries=1).collect()}
    want = {("a", 0): "THE BOARD RESOLVED", ("a", 1): "12,651", ("a", 2): "THE BOARD RESOLVED", ("b", 0): "", ("b", 1): "", ("b", 2): "long reply", ("c", 0): ""}
    assert shown() == want
    assert sorted(log.read_text().split("\n")[:-1]) == ["The board resolved", "fails here", "long reply"]
    assert shown() == want
    assert log.read_text().count("fails here") == 2 and log.read_text().count("board") == 1  # failures alone are asked again


def test_synthesise_and_keep(spark, regions, tmp_path):
    got = {(r.page_id, r.region_idx): r.shown for r in C.synthesise(regions, lambda s, u: u.split("\n")[0] + u[-8:], "m", str(tmp_path / "c"), "make").collect()}
    assert got[("a", 0)] == "Category: Titleresolved" and got[("b", 0)] == ""
    assert {r.shown for r in C.keep(regions).where("page_id = 'b'").collect()} == {"", "fails here", "long reply"}
