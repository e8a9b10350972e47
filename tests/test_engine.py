"""The document-reconstruction operators against plain loops, literals and DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import fonts, layout, sampling, typeface
from pagemill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("เก", ["เก"]), ("แล้ว", ["แล้", "ว"]), ("ปุ๋ย", ["ปุ๋", "ย"]), ("", []), (None, None)])
def test_clusters(spark, text, want):
    assert one(spark, text, T.clusters) == want


@pytest.mark.parametrize(("text", "want"), [("in 2023 and 1999", "in 2566 and 2542"), ("๑2023", "๑2023"), ("19๒๓", "2466"), ("120234", "120234"), ("", "")])
def test_years(spark, text, want):
    assert one(spark, text, T.years_to_be) == want


@pytest.mark.parametrize(("text", "want"), [("Ã Ì À > Ê Ï Ð", True), ("The board resolved to proceed", False), ("65 × 100 ÷ 80 = 81.25", False), ("§ 1 und § 363 BGB", False), ("", False)])
def test_garbage(spark, text, want):
    assert one(spark, text, T.looks_like_garbage) is want


@pytest.mark.parametrize(("text", "want"), [("-", False), ("12,651", False), ("N/A", False), ("(4)", False), ("Total assets", True), ("รายงาน", True), ("Note 50", True)])
def test_words(spark, text, want):
    assert one(spark, text, T.has_words) is want


@pytest.mark.parametrize(("text", "want"), [("Please provide the text.", ""), ("กรุณาระบุข้อความ", ""), ('"hello"', "hello"), ("“hello”", "“hello”"), (' " a " ', "a"), ('"', '"')])
def test_reply(spark, text, want):
    assert one(spark, text, T.clean_reply) == want


def test_strip_knows_all_white_space(spark):
    ends = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert one(spark, f"{ends}a b{ends}", T.py_strip) == "a b"


def loop_rows(items, gap=30):
    rows = []
    for r in sorted(items, key=lambda r: ((r[1] + r[3]) / 2, r[0])):
        for row in rows:
            low = min(row["y2"], r[3]) - max(row["y1"], r[1])
            if row["c"] == r[4] and low >= 0.5 * min(r[3] - r[1], row["y2"] - row["y1"]):
                row["m"].append(r)
                row["y1"], row["y2"] = min(row["y1"], r[1]), max(row["y2"], r[3])
                break
        else:
            rows.append({"c": r[4], "y1": r[1], "y2": r[3], "m": [r]})
    out = []
    for row in rows:
        parts = []
        for r in sorted(row["m"], key=lambda r: r[0]):
            if parts and r[0] - parts[-1][-1][2] <= gap:
                parts[-1].append(r)
            else:
                parts.append([r])
        out += [(min(p[0] for p in s), min(p[1] for p in s), max(p[2] for p in s), max(p[3] for p in s)) for s in parts]
    return out


def loop_blocks(items):
    blocks, before = [], 0
    for r in sorted(items, key=lambda r: (r[1], r[0])):
        h = r[3] - r[1]
        if blocks:
            b = blocks[-1]
            narrow = max(min(r[2] - r[0], b[2] - b[0]), 1)
            aligned = abs(r[0] - b[0]) <= 8 or (min(r[2], b[2]) - max(r[0], b[0])) / narrow > 0.6
            if b[4] == r[4] and aligned and -3 <= r[1] - b[3] <= 0.6 * max(h, before, 1):
                blocks[-1] = (min(b[0], r[0]), min(b[1], r[1]), max(b[2], r[2]), max(b[3], r[3]), b[4])
                before = h
                continue
        blocks.append(tuple(r))
        before = h
    return [b[:4] for b in blocks]


def test_folds_match_loops(spark):
    rng, rows = random.Random(4), []
    for page in range(60):
        for k in range(rng.randint(1, 18)):
            x, y = rng.randint(0, 200), rng.randint(0, 120)
            rows.append((page, k, x, y, x + rng.randint(3, 90), y + rng.randint(3, 20), f"t{k}", rng.choice("AB"), 0.0))
    df = spark.createDataFrame(rows, "page_id long, region_idx long, x1 int, y1 int, x2 int, y2 int, text string, category string, ink_height double")
    for f, loop in ((layout.group_rows, loop_rows), (layout.merge_wrapped, loop_blocks)):
        got = {}
        for r in f(df).orderBy("page_id", "region_idx").collect():
            got.setdefault(r.page_id, []).append((r.x1, r.y1, r.x2, r.y2))
        for page in range(60):
            assert got[page] == loop([(r[2], r[3], r[4], r[5], r[7]) for r in rows if r[0] == page])


def test_empty_report(spark):
    labels = spark.createDataFrame([], "page_id long, fit boolean, text string")
    assert layout.run_report(labels).first().asDict() == {"pages": 0, "regions": 0, "fitted": 0, "empty": 0, "rejected": 0, "fit_rate": 1.0}


def test_draws_do_not_depend_on_partitions(spark):
    faces = [(f"{c}/{f}-{w}", f, c, w, it) for f, c, w, it in fonts.FACES]
    runs = [[tuple(r) for r in spark.range(0, 200, 1, n).select("id", sampling.locale_of(F.col("id")).alias("l"), sampling.style_of(F.col("id"), F.lit(3), faces).alias("s")).orderBy("id").collect()] for n in (1, 3)]
    assert runs[0] == runs[1]
    g = random.Random(sampling.SEED + 7 * sampling.STRIDE)
    assert tuple(runs[0][7][1]) == (g.random() < 0.3, g.random() < 0.25)


def test_wrap_keeps_every_character(spark):
    text = "a bb  ccc supercalifragilistic d e\tf"
    found = one(spark, text, lambda c: layout.wrap(c, 8))
    assert "".join(found) == text
    assert all(len(x.rstrip()) <= 8 or " " not in x.strip() for x in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(repr([r[c] for c in names]) for r in got.collect())
    if name in catalogue.oracle_sql():
        found = duck.execute(catalogue.oracle_sql()[name])
        at = [[d[0] for d in found.description].index(c) for c in names]
        assert rows == sorted(repr([r[i] for i in at]) for r in found.fetchall())
    else:
        assert rows


def test_token_widths(spark):
    """As tokens cut and measured one by one; lines of a repeated key add up; a token has no row in any shuffle."""
    lines = ["a b  c", " a\tbb ", "x" * 5 + "ก้ c", "", None, " ", "\t", "a b c", "b" * 40 + " a"]
    rows = spark.createDataFrame([(k % 7, 0, t) for k, t in enumerate(lines)], "doc_id int, pos long, line string")
    table = spark.createDataFrame([("a", 700), ("b", 300), (" ", 250), ("ก", 610), ("a", 900)], "char string, advance int")
    cut = rows.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("line", F.lit(r"(\S+\s?|\s)"), F.lit(1))).alias("k", "token"))
    want = {(r.doc_id, r.k): (r.advance, r.kept) for r in typeface.measured(cut, table, 500, "doc_id", "k").collect()}
    found = typeface.token_widths(rows, table, 500, "doc_id", "pos")
    got = {(r.doc_id, k): tuple(t) for r in found.collect() for k, t in enumerate(r.tokens)}
    assert got == want
    plan = catalogue.queries()["q_wrap_metrics"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not any("k#" in part.split("]")[0] for part in plan.split("hashpartitioning(")[1:])


def test_pages_gathered(spark, tmp_path):
    """Words of a page stay together from its text on, so that no word is shuffled; ids may repeat."""
    texts = [(1, "a  b\n\n x y z"), (2, " ".join("w" * (k % 5) for k in range(40))), (1, "cd e\nf"), (3, None), (4, "")] + [(k, f"only {k}\nrow") for k in range(9, 60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = catalogue.page_words(spark, str(tmp_path))
    want = sorted(layout.group_rows(words).collect())
    plan = catalogue.queries()["q_group_rows"](spark, str(tmp_path))
    assert sorted(plan.collect()) == want and len(want) > 100
    assert plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1
    x1 = lambda line: [(40 + sum(len(p) * 7 + 7 for p in line[:k]) + 40 * (k // 8), w) for k, w in enumerate(line) if w]
    assert sorted((r.page_id, r.row, r.x1, r.text) for r in words.collect()) == sorted((d, row, x, w) for d, t in texts if t for row, line in enumerate(t.split("\n")) for x, w in x1(line.split(" ")))
