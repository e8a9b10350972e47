"""Repeated and missing ids, long and hot inputs, and figures of the corpus operators."""

import itertools
import math
import os
import random
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import common, components, fingerprints, htmlblocks, jaccard, jpeg, langid, mixing, passages, secrets, toxicity
from pagemill.llm.common import fold, shingle_hashes

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def test_join_tells_rows_apart(spark):
    """Rows of one id with different texts, rows without id, repeated rows and empty texts."""
    rng = random.Random(5)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = lambda w: " ".join(w[:-1] + words(rng, 1))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (None, near(a)), (None, " ".join(c)), (None, "one two three four five six"), (3, " ".join(c)), (3, " ".join(c)), (4, None), (5, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.join(df).collect()
    sets = [frozenset(shingle_hashes(t or "").tolist()) for _, t in rows]
    kinds = set(sets)
    like = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    links = {s: sum(o != s and bool(o) and bool(s) and like(s, o) for o in kinds) for s in kinds}
    want = Counter((d, links[s], sum(x == s for x in sets)) for (d, _), s in zip(rows, sets, strict=True))
    assert Counter((r.doc_id, r.n_links, r.n_copies) for r in got) == want
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    sizes = Counter((len(v), sum(d is None for d in v)) for v in classes.values())
    assert sizes == Counter([(2, 1), (2, 0), (3, 1), (1, 1), (3, 1)])  # A's, B's, C's, one alone, the empty ones
    assert all(k in v for k, v in classes.items() if k >= 0)
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()]
    assert len(kept) == 5 and (1, " ".join(a)) in kept and (1, " ".join(b)) in kept and (3, " ".join(c)) in kept


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_a_common_form_makes_no_hot_group(spark, parts):
    rng = random.Random(1)
    form = words(rng, 120)
    rows = [(i, " ".join(form + words(rng, 180))) for i in range(400)]
    _, keyed = common.with_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), "doc_id", "text")
    proposed = jaccard.proposals(jaccard.signatures(keyed).withColumn("node", F.col("doc_id")))
    assert proposed.where("hot").count() == 0 and proposed.count() < 3000


def test_plans_of_the_join_are_small(spark, monkeypatch):
    """A driver of bounded memory plans no query that holds the way to the components once for each place that reads them."""
    joins, cut = [], jaccard.cut
    number = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    monkeypatch.setattr(jaccard, "cut", lambda df, name: joins.append(number(df)) or cut(df, name))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    joins.append(number(jaccard.join(docs)))
    joins.append(number(jaccard.one_of_each(docs)))
    assert max(joins) <= 10, joins


def test_least_members():
    a, b = jaccard.least_members(np.array([5, 7, 9, 2]), np.array([7, 9, 5, 3]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 3), (5, 7), (5, 9)]


def test_components_join_few_times_the_links(spark, monkeypatch):
    """A chain, trees over one group by many tasks, and pairs: rounds join what is left, not all links again."""
    rng = random.Random(17)
    names = rng.sample(range(10_000), 700)
    chain, group = names[:300], names[300:400]
    links = list(zip(chain, chain[1:])) + [(x, y) for _ in range(6) for x, y in zip(group, rng.sample(group, 100)) if x != y] + list(zip(names[400::2], names[401::2]))
    joined, heavy_join = [], components.heavy_join
    monkeypatch.setattr(components, "heavy_join", lambda rows, *rest: joined.append(rows.count()) or heavy_join(rows, *rest))
    monkeypatch.setattr(components, "LAST", 8, raising=False)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(s) for s in (chain, group, *zip(names[400::2], names[401::2])) for x in s}
    assert sum(joined) <= 8 * len(links), (sum(joined), len(links))


def test_drawn_follows_the_mixture(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i % 40 if i % 7 else None, " ".join(words(rng, rng.randint(1, 30))), "big" if i < 90 else f"s{i % 3}", i) for i in range(120)]
    rows += [rows[3], rows[3], (None, "", "blank", 1), (None, None, "blank", 2), (None, None, None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, block int").repartition(5).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    mixed, out = mixing.mixture(df, block=300).collect(), mixing.drawn(df, block=300)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.source) for r in mixed) == Counter((r.doc_id, r.source) for r in out.collect())
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in rows}  # no row is lost
    tokens = lambda r: len((r.text or "").split())
    by_block = Counter()
    for r in mixed:
        by_block[r.block] += r.tokens
    placed = [tokens(r) for r in out.collect()]
    order = [r.tokens for r in sorted(mixed, key=lambda r: (r.block, r.place))]
    assert len(by_block) > 3 and placed == order  # partitions hold blocks one after the other, rows by their places


def test_sources_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixing.mixture(spark.createDataFrame([(i, "a", str(i)) for i in range(3)], "doc_id long, text string, source string"))


def test_near_passages_beside_lesser_ids(spark):
    """One word put in or changed in a passage of 60 words, of which lesser ids hold 45."""
    rng = random.Random(3)
    rows, wanted = [], set()
    for k in range(80):
        own, i, at = words(rng, 60), 10 * k, rng.randrange(60)
        new = own[:at] + words(rng, 1) + own[at + k % 2 :]
        rows += [(i + j, " ".join(words(rng, 30) + own[j + 4 : j + 49] + words(rng, 60))) for j in range(k % 3)]
        rows += [(i + 5, " ".join(words(rng, 30) + own + words(rng, 40))), (i + 6, " ".join(words(rng, 50) + new + words(rng, 20)))]
        wanted.add((i + 5, i + 6))
    found = {(r.other_doc_id, r.doc_id) for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found & wanted) >= 0.95 * len(wanted) and found <= wanted


def test_members_of_large_groups_all_meet(spark, monkeypatch):
    """Whatever the size from which groups are dealt, near passages beside lesser ids that hold parts are found."""
    rng = random.Random(29)
    rows, wanted = [], set()
    for k in range(50):
        own, i, at = words(rng, 60), 20 * k, rng.randrange(60)
        new = own[:at] + words(rng, 1) + own[at + 1 :]
        rows += [(i + j, " ".join(words(rng, 30) + own[2 * j : 2 * j + 45] + words(rng, 60))) for j in range(8)]
        rows += [(i + 8, " ".join(words(rng, 30) + own + words(rng, 40))), (i + 9, " ".join(words(rng, 50) + new + words(rng, 20)))]
        wanted.add((i + 8, i + 9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for meet in (512, 2):
        monkeypatch.setattr(passages, "MEET", meet)
        found[meet] = {(r.other_doc_id, r.doc_id) for r in passages.repeated(df).collect()}
    assert len(found[512] & wanted) >= 0.95 * len(wanted) and found[2] & wanted >= found[512] & wanted


def test_partners_in_a_large_group_are_not_joined(spark, monkeypatch):
    """Those with enough shingles that another one has, as by brute force, from few rows for each shingle that many have."""
    rng = random.Random(31)
    form, written, cut = list(range(40)), {}, passages.cut
    monkeypatch.setattr(passages, "cut", lambda df, name: written.setdefault(name, df.count()) and cut(df, name))
    members = []
    for k in range(300):
        own = form[rng.randrange(25) :] if k % 2 else rng.sample(form, 40)[: rng.randrange(1, 40)]
        own = [rng.randrange(1 << 30, 1 << 32) for _ in range(rng.randrange(9))] + own + own[: k % 3]
        members.append((k % 7 // 6, k, k % 5, bytearray(np.array(own, dtype="<u4").tobytes())))
    members.append((2, 1000, 0, bytearray(np.arange(60, dtype="<u4").tobytes())))
    df = spark.createDataFrame(members, "signature long, node long, centre long, around binary").repartition(3)
    counts, wanted = Counter(), set()
    for signature, *_, x in members:
        counts.update((signature, v) for v in set(np.frombuffer(x, dtype="<u4").tolist()))
    for signature, node, centre, x in members:
        at = [i for i, v in enumerate(np.frombuffer(x, dtype="<u4").tolist()) if counts[signature, v] > 1]
        if len(at) >= 16 and at[-1] - at[0] + 1 >= 20:
            wanted.add((signature, node, centre))
    got = passages.with_partners(df, 20, 0.8)
    assert {(r.signature, r.node, r.centre) for r in got.collect()} == wanted and 100 < len(wanted) < 300
    alone = sum(n == 1 for n in counts.values())
    assert written["elements"] <= 3 * (len(counts) - alone) + alone + len(members)


def test_hashes_and_windows_of_many_texts():
    """Those of all texts at once are those of each text."""
    rng = random.Random(8)
    texts = ["", "a", "...", "a b c d", "ΑΣ ΣΑΣ", "İ x y z w q", "the " * 90, "", *(" ".join(rng.choices("qwe" if k % 2 else string.ascii_letters, k=rng.randrange(150))) for k in range(60))]
    assert sorted({j - i for i, j in common.text_slices(texts, 300)}) != [1] and [i for s in common.text_slices(texts, 300) for i in range(*s)] == list(range(len(texts)))
    h, begin = common.shingles_of(texts)
    assert [h[a:b].tolist() for a, b in itertools.pairwise(begin)] == [common.shingle_hashes(t).tolist() for t in texts]
    for least in (2, 3, 46):
        long = [own for a, b in itertools.pairwise(begin) if len(own := h[a:b]) >= least]
        edges = np.cumsum([0, *map(len, long)])
        wanted = [(k, a + edges[k], c + edges[k], b + edges[k]) for k, own in enumerate(long) for a, c, b in passages.windows(own, least)]
        assert sorted(zip(*(x.tolist() for x in passages.windows_of(np.concatenate(long), edges, least)), strict=True)) == sorted(wanted)


def test_filed_windows_are_shuffled_in_few_rows(spark, tmp_path):
    """Each member of a signature with its first, as by brute force, from a row for each part of the keys."""
    rng = random.Random(12)
    same, long = words(rng, 90), words(rng, 300)
    rows = [*((100 - k, words(rng, k) + same + words(rng, 5 * k)) for k in range(20)), (3, long + long), (9, long[50:]), (4, ["the"] * 120), (5, words(rng, 9)), (6, [])]
    spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "node long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    groups, seeds = {}, [(f + 1) * 0xA24BAED4963EE407 % (1 << 64) for f in range(3)]
    for i, w in rows:
        h, own = common.shingle_hashes(" ".join(w)), {}
        for f, seed in enumerate(seeds):
            v = common.mix(h ^ np.uint64(seed))
            for a, c, b in passages.windows(v, 46):
                for side, at in enumerate((c - 23, c + 22, None)):
                    if at is None or a <= at < b:
                        key = int(v[c]) * 3 + side + (0 if at is None else int(h[at]))
                        own.setdefault(int(common.mix(np.array([key % (1 << 64)], dtype=np.uint64)).view(np.int64)[0]), []).append((c, c - a, b - 1 - c, 3 * f + side))
        for key, found in own.items():
            found.sort()
            groups.setdefault(key, []).extend((i, *x) for k, x in enumerate(found) if not k or x[0] - found[k - 1][0] >= 46)
    wanted = set()
    for key, members in groups.items():
        (a, ca, before, after, _), *others = sorted(members)
        for b, cb, x, y, slot in others:
            p, q = min(before, x), min(after, y)
            wanted.add((key, a, b, (ca - cb) >> 5, ca - p, ca + q + 1, cb - p, cb + q + 1, 1 << slot, ca, cb))
    files = passages.filed(docs)
    assert {tuple(r) for r in passages.linked(files).collect()} == wanted and len(wanted) > 300
    assert files.count() <= passages.parts_of(docs) < len(groups) / 5


def test_passages_of_rows_and_places(spark):
    """A second copy in one text, rows of one id, rows without id, and a passage beyond 65,535 shingles."""
    rng = random.Random(4)
    own, other, same = words(rng, 60), words(rng, 60), words(rng, 70)
    rows = [(1, " ".join(words(rng, 30) + own + words(rng, 20))), (2, " ".join(own + words(rng, 90) + own + words(rng, 9)))]
    rows += [(7, " ".join(words(rng, 20) + other)), (7, " ".join(other + words(rng, 30))), (None, " ".join(words(rng, 9) + same)), (None, " ".join(same + words(rng, 40)))]
    found = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.other_doc_id, r.doc_id) for r in found) == Counter({(1, 2): 2, (7, 7): 1, (None, None): 1})
    assert sorted(r.first_word for r in found if r.doc_id == 2) == [0, 150]
    long = [f"w{i}" for i in range(140_000)]
    got = passages.repeated(spark.createDataFrame([(1, " ".join(words(rng, 20) + long)), (2, " ".join(long + words(rng, 10)))], "doc_id long, text string")).collect()
    assert [(r.first_word, r.last_word) for r in got] == [(0, 139_999)]


def test_leaders_meet_only_what_is_like_them():
    x, y = np.arange(0, 120, dtype="<u4"), np.arange(500, 620, dtype="<u4")
    asked = []
    like = lambda a, b: asked.append(1) or True
    assert passages.led([x, y, x[:40], x[2:90], y[5:]], 37, 46, like) == [(0, 3), (1, 4)] and len(asked) == 2


def test_sketches_merge(spark):
    texts = [" ".join(words(random.Random(k), 300)) for k in range(3)]
    a, b, c = (fingerprints.Sketch.of(t) for t in texts)
    assert a.merge(a) is a and a.merge(fingerprints.Sketch.of(texts[0])).n_shingles == 296
    both = a.merge(b)
    assert both.merge(both).n_shingles == both.n_shingles and both.jaccard(both.merge(both)) == 1.0
    assert (a.merge(b).merge(c).hashes == c.merge(b).merge(a).hashes).all() and both.jaccard(b.merge(a)) == 1.0
    assert a.containment(both) == 1.0 and fingerprints.Sketch.parse(str(both)).jaccard(both) == 1.0
    tiny = fingerprints.Sketch.of("a b c d e f")
    assert tiny.merge(tiny).jaccard(tiny) == 1.0


def test_likeness_is_near_the_exact_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    errors = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b, e = (set(shingle_hashes(x).tolist()) for x in (t, n, fingerprints.edited(t, n)))
        for exact, est in ((len(a & b) / len(a | b), got[d].near_next), (len(a & e) / len(a | e), got[d].near_edited), (len(a & e) / len(a), got[d].kept_in_edited)):
            errors.append((abs(exact - est), min(len(a), len(e))))
    assert np.mean([x for x, n in errors if n >= 200]) < 0.03 and np.mean([x for x, _ in errors]) < 0.05
    print("mean error", np.mean([x for x, _ in errors]), "of short texts", np.mean([x for x, n in errors if n < 30]))


def test_language_against_exact_sets(spark):
    """Filters answer as exact sets of n-grams do, but for their false positives."""
    rng = random.Random(2)
    own = {lang: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(300)) for lang, letters in (("x", "abcdef"), ("y", "efghij"), ("z", "klmnop"))}
    grams = {lang: np.unique(langid.ngrams(t)[0]) for lang, t in own.items()}
    f = langid.Filter.build(grams, ["x", "y", "z"])
    for lang, text in own.items():
        some = " ".join(rng.sample(text.split(), 60))
        h = langid.ngrams(some)[0]
        exact = np.array([np.isin(h, grams[k]).mean() for k in ("x", "y", "z")])
        assert np.abs(f.shares(h) - exact).max() < 0.02 and f.predict(some)[0] == ("x", "y", "z")[int(exact.argmax())] == lang


def test_colour_jpeg_of_another_writer(spark):
    """Progressive 4:2:0 colour by the JVM's encoder decodes near to its own decoder's result."""
    jvm = spark.sparkContext._jvm
    w, h = 40, 24
    image = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(128 + 90 * math.sin(x / 9 + k) * math.cos(y / 7 - k)) for k in range(3))
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    want = np.array([[[back.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)])
    assert np.abs(jpeg.decode(data).rgb().astype(int) - want).mean() < 4


def test_labeller_on_long_pages_and_unseen_names():
    model = htmlblocks.train()
    page = "<nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>word{i} and more of it.</p>" for i in range(50_000)) + "</article>"
    pages = [htmlblocks.blocks(page)] + [htmlblocks.blocks("<nav>x</nav><article><p>a b</p></article>")] * 63
    got = model.label(pages)
    assert len(got[0]) == 50_001 and got[0][1:].mean() > 0.99 and all(len(y) == 2 for y in got[1:])
    alone = model.label(pages[1:2])[0]
    assert (alone == got[1]).all()
    assert [b.text for b in htmlblocks.blocks("<p>Let <math><mi>x</mi></math> be <object>one</object>.</p>")] == ["Let x be one."]
    rng = np.random.default_rng(77)
    held = htmlblocks.train(300, 3, 0)
    pages = [p for p in (htmlblocks.sample(rng, 1) for _ in range(100)) if p[0]]
    wrong = sum(int((g != (y > 0)).sum()) for g, (_, y) in zip(held.label([b for b, _ in pages]), pages, strict=True))
    assert wrong / sum(len(y) for _, y in pages) < 0.2
    first, last = (htmlblocks.vectors(htmlblocks.blocks(f"<p>{'plain ' * 100}{w}</p>")) for w in ("tail", "other"))
    assert (first != last).any()  # words after 400 characters count


def test_planted_secrets(spark):
    """Recall and precision over planted values of kinds and names that training does not make."""
    rng = random.Random(6)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, wanted = [], {}
    for i in range(120):
        kind = i % 6
        value = [some(b62, 24), some(hexes, 32), some(b62, 64), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), some(b62, 20), some(hexes, 40)][kind]
        text = [f'db_password: "{value}"', f"export SECRET_TOKEN={value}", f"client_secret = '{value}'", f"the id is {value} here", f"commit {some(hexes, 40)} by me", f"md5 {some(hexes, 32)} of the file"][kind]
        rows.append((i, f"{' '.join(words(rng, 6))} {text} {' '.join(words(rng, 6))}"))
        if kind < 4:
            wanted[i] = value
    df = spark.createDataFrame(rows, "doc_id long, text string")
    forest = secrets.train(secrets.labelled_findings(spark), secrets.dictionary(df))
    said = {r.doc_id for r in secrets.findings(df, forest).where("secret").collect()}
    recall, precision = len(said & set(wanted)) / len(wanted), len(said & set(wanted)) / max(1, len(said))
    print("recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.9


def test_dictionary_counts_all_documents(spark):
    df = spark.createDataFrame([(1, "Apple apple pear"), (2, "apple plum7 über-Äpfel"), (3, None), (4, "pear Äpfel")], "doc_id long, text string")
    assert secrets.dictionary(df) == ("apple", "pear", "äpfel") and secrets.dictionary(df, 1) == ("apple",)
    assert secrets.dictionary(df.limit(0)) == ()


def test_repeated_labels(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i in range(60) for t in (0, i % 2)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 3) != 1)
    got = toxicity.score(docs, model, F.lit(False)).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_a_written_table_leaves_no_shuffle(spark):
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, said = held(), spark.conf.get(common.CLEANED)
    out = common.cut(spark.range(1000).repartition(3, "id"), "t")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert out.count() == 1000 and spark.conf.get(common.CLEANED) == said


def test_stored_hashes():
    h = np.array([0, 1 << 16, (1 << 64) - 1, 0x0123456789ABCDEF], dtype=np.uint64)
    assert passages.read(passages.stored(h)).tolist() == [x >> 16 for x in h.tolist()] and not len(passages.read(passages.stored(h[:0])))


def test_no_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        get = staticmethod(lambda name, default: default)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_dir(Session)
    Context.master = "local[2]"
    assert common.shared_dir(Session).startswith("file:///") and common.shared_dir(Session) == common.shared_dir(Session)


@pytest.mark.skip(reason="not yet seen to pass; see README")
def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, clashing columns; and an empty table."""
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    long = " ".join(base.first().text.split()[:20] * 3000)
    schema = base.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", key string, block int, label string"
    odd = [(900, None, "en", "web", 0, "k", 1, "l"), (901, "", None, None, 0, None, None, None), (902, long, "en", None, len(long), "k", 2, "l"), (903, "12 34 !!", "de", "web", 8, "k", 3, "l"), (903, base.first().text + " zz", "en", "web", 3, "k", 4, "l"), (None, base.first().text, "en", "web", 1, "k", 5, "l")]
    rows = base.selectExpr("*", "'k' AS key", "7 AS block", "'l' AS label").unionByName(spark.createDataFrame(odd + odd[2:3], schema))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in rows.collect()} and all(r.n_tokens == len(r.ids) // 4 for r in out)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == rows.columns
    rows.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


