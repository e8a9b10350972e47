"""The corpus operators on edge rows, against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import bpe, components, fingerprints, htmlblocks, jaccard, jpeg, langid, mixing, passages, secrets, toxicity
from pagemill.llm.common import fold, shingle_hashes, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, label string"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, tiny, very long, repeated and tied rows, with extra columns of clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20000))
    texts = [None, "", " ", "?!", "a", "x" * 30000, long, "same text here", "same text here", "Zürich 😀 naïve", "token = \"" + "ab12" * 10 + "\""]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None if t is None else len(t), 0.5, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], (None, "no id", "en", "s", 5, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_fingerprints(docs, odd, none):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    got = by_id(fingerprints.fingerprints(docs))
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = fingerprints.edited(t, n)
        assert got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = (set(shingle_hashes(x).tolist()) for x in (t, new))
        if len(a | b) > 400:
            assert abs(got[d].near_edited - len(a & b) / len(a | b)) < 0.2
    s, t = fingerprints.Sketch.of("a b c d e f g h"), fingerprints.Sketch.of("h g f e d c b a")
    assert fingerprints.Sketch.parse(str(s)).jaccard(s) == 1.0
    assert s.merge(t).containment(s) <= 1.0
    found = fingerprints.fingerprints(odd).collect()
    assert len(found) == odd.count() and all(0 <= r.near_next <= 1 for r in found)
    assert len({r.fingerprint for r in found if r.doc_id in (7, 8)}) == 1
    assert fingerprints.fingerprints(none).count() == 0


def test_jpeg_round_trip(odd, none):
    for r in jpeg.digests(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        n, payload = jpeg.padded(r.text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert jpeg.digests(none).count() == 0
    assert by_id(jpeg.tensors(jpeg.store(odd)))[1].rgb is not None


def test_jpeg_fields_equal_symbols(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (1, 5, 6, 23):
        data = jpeg.pack(rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes())
        fast = jpeg.decode(data)
        with monkeypatch.context() as m:
            m.setattr(jpeg._Scan, "at_once", lambda *a: False)
            slow = jpeg.decode(data)
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components, strict=True))


def test_jpeg_of_another_writer(spark):
    """Progressive files by the JVM's encoder, with smooth content, decode as its own decoder does."""
    jvm = spark.sparkContext._jvm
    w, h = 37, 26
    image = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    for y in range(h):
        for x in range(w):
            image.getRaster().setSample(x, y, 0, int(128 + 60 * math.sin(x / 5) + 50 * math.cos(y / 4)))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
    want = np.array([[back.getSample(x, y, 0) for x in range(w)] for y in range(h)])
    assert np.abs(jpeg.decode(data).rgb()[:, :, 0].astype(int) - want).max() <= 1


def test_mixing(spark, docs, odd, none):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), "en", "big" if i < 300 else f"s{i % 4}", 1) for i in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len(r[1].split())
    exponent, w = mixing.weights(dict(tokens))
    p = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    z = sum(x**exponent for x in p.values())
    assert all(abs(w[s] - p[s] ** exponent / z) < 1e-9 for s in p)
    drawn = mixing.mixture(df, block=2000).collect()
    assert {r.doc_id for r in drawn} == set(range(480))
    total = Counter()
    for r in drawn:
        total[r.source] += r.tokens
    n = sum(total.values())
    assert all(abs(total[s] / n - w[s]) < 0.02 for s in w)
    assert max(Counter(r.doc_id for r in drawn).values()) <= math.ceil(mixing.REPEATS)
    places = defaultdict(list)
    for r in drawn:
        places[r.block].append(r.place)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert {r.doc_id for r in mixing.mixture(odd).collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.drawn(odd).columns == odd.columns
    assert mixing.mixture(none).count() == 0
    for r in mixing.mixture(docs).join(docs, "doc_id").collect():
        assert r.tokens == len(r.text.split())


def test_mixing_limits():
    tokens = {"a": 900, "b": 90, "c": 10}
    e, w = mixing.weights(tokens, entropy=0.9, repeats=None)
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.9 * math.log(3)) < 1e-6
    e, w = mixing.weights(tokens, entropy=None, repeats=3.0)
    rates = [w[s] / tokens[s] for s in tokens]
    assert abs(max(rates) / min(rates) - 3.0) < 1e-6


def test_language(docs, odd, none):
    held = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held)
    got = langid.predict(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    found = by_id(langid.predict(odd, model, held))
    assert {found[i].lang_pred for i in (0, 1, 2, 3)} == {"und"} and found[4].lang_pred in model.languages
    assert langid.predict(none, langid.train(none, ~held), held).count() == 0
    assert by_id(langid.predict(odd, langid.train(none, ~held), held))[4].lang_pred == "und"


def test_language_filter_has_no_false_negatives():
    grams = {"x": langid.ngrams("hello world")[0], "y": langid.ngrams("guten tag welt")[0]}
    f = langid.Filter.build(grams, ["x", "y"], 1 << 12)
    assert (f.members(grams["x"])[:, 0] & 1).all() and (f.members(grams["y"])[:, 0] & 2).all()


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
        "<div class='ad'>Buy this now.</div><article><h1>Head &amp;amp; line</h1><p>First <b>bold</b>\n text.<br>More of it.<p>Second one here.</article>"
        "<div class='comments'><p>I liked it.</p></div><footer>&copy; example.com</footer>"
    )
    rows = [(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<nav>only</nav>"), (0, "u", page)]
    got = htmlblocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), htmlblocks.train()).collect()
    texts = [r.text for r in got if r.page_id == 0]
    assert texts == ["Head &amp; line\nFirst bold text. More of it.\nSecond one here."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2, 3))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in htmlblocks.extract(pages, htmlblocks.train()).join(pages.select("page_id", "html"), "page_id").collect():
        want = [b.text for b in htmlblocks.blocks(r.html) if any(n == "article" for n, _ in b.path)]
        assert r.text == "\n".join(want)


def test_labeller_on_unseen_templates():
    rng = np.random.default_rng(77)
    pages = [p for p in (htmlblocks.sample(rng) for _ in range(150)) if p[0]]
    got = htmlblocks.train().label([b for b, _ in pages])
    wrong = sum(int((g != (y > 0)).sum()) for g, (_, y) in zip(got, pages, strict=True))
    assert wrong / sum(len(y) for _, y in pages) < 0.04


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    m = htmlblocks.Labeller()
    x, mask = htmlblocks.padded([rng.normal(size=(n, htmlblocks._SIZE)) for n in (3, 5)])
    y = rng.integers(0, 2, mask.shape).astype(float)

    def loss():
        z = m.logits(x, mask)[0]
        return float(np.where(mask, np.logaddexp(0, z) - y * z, 0).sum() / mask.sum())

    g = m.gradients(x, mask, y)
    for name in ("fx", "fh", "bh", "bb", "o", "x"):
        flat, i = m.p[name].reshape(-1), 5
        flat[i] += 1e-5
        up = loss()
        flat[i] -= 2e-5
        down = loss()
        flat[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[name].reshape(-1)[i]) < 1e-6


def test_secrets(spark, docs, odd, none):
    forest = secrets.train(secrets.labelled_findings(spark))
    hexes = ["".join(random.Random(i).choice("0123456789abcdef") for _ in range(40)) for i in range(3)]
    texts = [f'set token = "{hexes[0]}" now', f"see commit {hexes[1]} for it", "card 4556737586899855 here", f"api_key={hexes[2]}&x", "https://a.org/news/2024-05-06-long-title-of-it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.secret) for r in secrets.findings(df, forest).collect()}
    assert (0, True) in found and (3, True) in found and not found & {(1, True), (2, True), (4, True)}
    clean = {r.doc_id: r.text for r in secrets.redacted(df, forest).collect()}
    assert clean[0] == 'set token = "[SECRET]" now' and clean[1] == texts[1] and clean[2] == texts[2]
    assert secrets.redacted(odd, forest).columns == odd.columns
    kept = secrets.redacted(odd, forest).collect()
    assert len(kept) == odd.count() and {r.text for r in kept if r.doc_id == 0} == {None}
    assert secrets.findings(none, forest).count() == 0
    plan = secrets.findings(docs, forest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

    def by_tree(node, f):
        while not isinstance(node, float):
            node = node[2] if f[node[0]] <= node[1] else node[3]
        return node

    scored = secrets.labelled_findings(spark, 64).select(secrets.describe(F.col("before"), F.col("found"), F.col("after")).alias("f")).select("f", forest.score(F.col("f")).alias("s"))
    for r in scored.collect():
        assert abs(r.s - np.mean([by_tree(t, r.f.asDict()) for t in forest.trees])) < 1e-9


def test_long_values_are_one_secret(spark):
    """Values of thousands of characters after a name: one finding each, masked to their end."""
    rng = random.Random(31)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    values = [some("0123456789abcdef", 900), some(b64, 513), some(b64, 5000), "eyJhbGciOiJIUzI1NiJ9." + some(b64 + "-_", 3000) + "." + some(b64, 43), *(some(b64 + "+/", 4000) for _ in range(6))]
    df = spark.createDataFrame([(i, f'set token="{v}" now') for i, v in enumerate(values)], "doc_id long, text string")
    forest = secrets.train(secrets.labelled_findings(spark))
    found = [(r.doc_id, r.length, r.secret_sha256) for r in secrets.findings(df, forest).orderBy("doc_id", "ordinal").collect()]
    assert found == [(i, len(v), hashlib.sha256(v.encode()).hexdigest()) for i, v in enumerate(values)]
    assert {r.text for r in secrets.redacted(df, forest).collect()} == {'set token="[SECRET]" now'}


def windows_of(text, n=50):
    w = word_hashes(text or "")
    return {w[k : k + n].tobytes() for k in range(len(w) - n + 1)}


def test_passages(spark, docs, odd, none):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {x for r in passages.repeated(docs).collect() for x in (r.doc_id, r.other_doc_id)}
    seen = defaultdict(set)
    for d, t in texts.items():
        for w in windows_of(t):
            seen[w].add(d)
    assert {d for s in seen.values() if len(s) > 1 for d in s} <= got
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    shared = [word() for _ in range(60)]
    planted = [(i, " ".join([*(word() for _ in range(rng.randint(0, 300))), *(shared if i < 40 else []), *(word() for _ in range(200))])) for i in range(80)]
    found = passages.repeated(spark.createDataFrame(planted, "doc_id long, text string")).collect()
    assert {x for r in found for x in (r.doc_id, r.other_doc_id)} == set(range(40))
    assert all(r.last_word - r.first_word >= 55 for r in found)
    assert {r.doc_id for r in passages.repeated(odd).collect()} <= set(range(11))
    assert passages.repeated(none).count() == 0


def test_passages_beside_a_shorter_one(spark):
    """Two texts share a passage of which texts with lesser ids have a part; and runs of one word."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    whole = some(52)
    parts = [(i, some(30) + whole[k : k + 45] + some(60)) for i, k in enumerate((0, 2, 4, 7))]
    rows = [*parts, *((i, some(20) + whole + some(70)) for i in (10, 11, 12)), (20, ["The"] * 66 + some(40)), (21, some(9) + ["The"] * 90)]
    found = passages.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r.other_doc_id, r.doc_id) for r in found} == {(10, 11), (10, 12), (20, 21)}


def test_passages_of_a_verified_member(spark):
    """The least id has a part of a passage, the next one all of it, a third too little of the part."""
    rng = random.Random(35)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    rows, wanted = [], set()
    for k in range(0, 90, 3):
        whole = some(56)
        rows += [(k, some(30) + whole[:55] + some(40)), (k + 1, some(20) + whole + some(60)), (k + 2, some(50) + whole[6:] + some(30))]
        wanted |= {(k, k + 1), (k + 1, k + 2)}
    found = passages.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)).collect()
    assert {(r.other_doc_id, r.doc_id) for r in found} == wanted


def test_passages_with_a_word_put_in_or_left_out(spark):
    """Passages of 50 to 70 words with one edit at every place; similarity 0.8 or more."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    rows, wanted = [], set()
    for n in range(50, 71):
        for k in range(0, n, 3):
            own = some(n)
            new = own[:k] + some(1) + own[k + (n % 2 and n > 51) :]
            x, y = (set(shingle_hashes(" ".join(w)).tolist()) for w in (own, new))
            if len(x & y) >= 0.8 * len(x | y):
                wanted.add((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(some(30) + own + some(40))), (len(rows) + 1, " ".join(some(50) + new + some(20)))]
    found = {(r.other_doc_id, r.doc_id) for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print(len(found & wanted), len(wanted))
    assert len(found & wanted) >= 0.97 * len(wanted)
    assert all(b == a + 1 for a, b in found)


def test_windows_hold_every_passage():
    rng = np.random.default_rng(5)
    v = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    found = passages.windows(v, 46)
    for a in range(300 - 46):
        for b in (a + 46, 300):
            c = a + int(v[a:b].argmin())
            assert any(x <= a and b <= y and z == c for x, z, y in found)


def test_toxicity(spark, docs, odd, none):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(base, 20))
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["groupname"] * a + ["insultword"] * b
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ~held)
    truth = {i: t for i, _, t in labels}
    got = toxicity.score(df, model, held).where("held_out").collect()
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.98
    v = model.factors[:3]
    pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i + 1, len(v)))
    assert abs(model.raw(np.arange(len(v))) - (model.bias + model.weights[:3].sum() + pairs)) < 1e-9
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model, held).collect())
    assert toxicity.score(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"), ~held), held).count() == 0


def brute_classes(texts):
    sets = {d: set(shingle_hashes(t or "").tolist()) for d, t in texts.items()}
    up = {d: d for d in texts}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / union if union else 1.0) >= 0.8:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in texts}


def test_join(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = by_id(jaccard.join(docs))
    assert {d: r.class_id for d, r in got.items()} == brute_classes(texts)
    assert {d: r.n_links for d, r in got.items()} == brute_links(texts.items())
    rng = random.Random(6)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(300)]
    many = []
    for i in range(120):  # one large group of near copies: each has two words of its own
        words = list(base)
        for _ in range(2):
            words[rng.randrange(300)] = f"n{rng.randint(0, 10**6)}"
        many.append((i, " ".join(words)))
    got = by_id(jaccard.join(spark.createDataFrame(many, "doc_id long, text string")))
    assert {r.class_id for r in got.values()} == {0}
    assert jaccard.one_of_each(spark.createDataFrame(many, "doc_id long, text string")).count() == 1
    assert {d: r.n_links for d, r in got.items()} == brute_links(many)


def brute_links(rows):
    """The number of other shingle sets that each row's set is similar to."""
    sets = {d: frozenset(shingle_hashes(t or "").tolist()) for d, t in rows}
    kinds = [s for s in set(sets.values()) if s]
    n = {s: sum(o is not s and len(s & o) >= 0.8 * len(s | o) for o in kinds) for s in kinds}
    return {d: n.get(s, 0) for d, s in sets.items()}


def test_join_loses_no_link_of_a_hot_bucket(spark, monkeypatch):
    """A common form of text, of which most are a little less than similar and some pairs are similar."""
    rng = random.Random(12)
    form, rows = [f"v{rng.randint(0, 10**6)}" for _ in range(400)], []
    own = lambda n: [f"n{rng.randint(0, 10**9)}" for _ in range(n)]
    for i in range(150):
        tail = own(60)
        rows.append((2 * i, " ".join(form + tail)))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join(form + tail[:45] + own(15))))
    brute = brute_links(rows)
    assert min(brute.values()) == 0 < max(brute.values())
    for block, parts in ((512, 1), (16, 7)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = by_id(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)))
        assert {d: r.n_links for d, r in got.items()} == brute
        assert {d: r.class_id for d, r in got.items()} == brute_classes(dict(rows))


def test_common_shingles(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    x, y = ([np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in sizes] for sizes in ((0, 3, 40, 20), (50, 0, 8)))
    assert jaccard.common_shingles(x, y).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]


def test_join_edge_rows(spark, odd, none):
    found = jaccard.join(odd).collect()
    assert len(found) == odd.count() and {r.class_id for r in found if r.doc_id in (0, 1)} == {0}
    assert jaccard.one_of_each(odd).columns == odd.columns
    assert jaccard.join(none).count() == 0


def test_pruning_keeps_what_may_pass():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 32, (4000, jaccard.VALUES), dtype=np.uint32)
    for share, low, high in ((0.8, 0.999, 1.0), (0.3, 0.0, 0.01)):
        b = np.where(rng.random(a.shape) < share, a, a + 1).astype(np.uint32)
        assert low <= jaccard.surviving(a, b, least).mean() <= high


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[200], got[300]} == {100}


def reference_encoding():
    import base64

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, odd, none):
    enc, codec = reference_encoding(), bpe.Codec.load(PATH, PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab 's're'll'  \n\té中😀12.,!?-_'t") for _ in range(rng.randint(0, 200))) + " " * rng.randint(0, 60) + "x" * rng.randint(0, 60)
        want = np.array(enc.encode_ordinary(text), dtype="<u4").tobytes()
        assert all(codec.encode(text, c, o) == want for c, o in ((5, 1), (16, 3), (33, 16), (1000, 10)))
        assert codec.decode(want) == text.encode()
    for df in (docs, odd):
        got = bpe.digests(df, PATH, PATTERN, 64, 8)
        for r in got.join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            ids = enc.encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(none, PATH, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd, PATH, PATTERN), PATH, PATTERN).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back)


def test_pipeline(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mixing", "byte_bpe"]
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {d for d, c in brute_classes(texts).items() if d == c}
    assert {r.doc_id for r in rows} == kept
    codec = bpe.Codec.load(PATH, PATTERN)
    for r in rows:
        assert r.n_tokens == len(r.ids) // 4
        text = codec.decode(bytes(r.ids)).decode()
        assert text == texts[r.doc_id] or "[SECRET]" in text
