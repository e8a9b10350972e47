"""Secret scans: a random forest that removes false positives from pattern matches.

Candidates are found by one pattern: assignments to a name that speaks of a credential, private
key blocks, and long tokens that hold a digit. Each is described by its length, character
classes and the transitions between them, its share covered by dictionary words, whether it or
its surroundings look like a path, and the words around it. The dictionary is the corpus's own: the
``DICTIONARY`` words that most of its documents hold, counted over all of them, beside a few fixed ones. The forest is grown level by level
from labelled findings with DataFrame aggregations (Poisson-like bootstrap by hash, a random
subset of features at each node) and scored as one SQL expression, so text never leaves the JVM.

No table of labelled findings comes with the corpus; ``labelled_findings`` derives one from hashes
(kinds of real credentials against hashes named as such, identifiers, numbers, paths, words and
placeholders). Any DataFrame of (before, found, after, label) can take its place.

Defined results: null and empty texts have no finding; the same secret found twice is two findings
with their own ordinals; a null id is kept as null; an empty table gives an empty result; further
columns of the input are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import cut, discard

#: Names that speak of a credential.
NAMES = "passwords?|passwd|pwd|secrets?|tokens?|api[_-]?keys?|access[_-]?keys?|auth[_-]?keys?|private[_-]?keys?|client[_-]?secret|credentials?|bearer"
_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
_TOKEN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
_LOOSE = rf"\b(?i:{NAMES})[\"']?\s{{0,3}}[:=]{{1,2}}>?\s{{0,3}}[\"']?[^\s\"'<>]{{6,}}+"
CANDIDATE = f"{_BLOCK}|{_LOOSE}|{_TOKEN}"
_VALUE = rf"^(?:(?i:{NAMES})[\"']?\s*[:=]+>?\s*[\"']?)?([\s\S]*)$"
#: Code points of context kept on either side; words of the corpus's dictionary, and their least length.
CONTEXT, DICTIONARY, LEAST_LETTERS = 48, 4000, 4
#: Frequent words and word parts that speak against chance (a fixed list, longest first).
WORDS = "example|password|changeme|version|function|default|config|string|object|number|update|secret|sample|dummy|value|index|class|token|error|admin|image|table|state|event|query|test|true|null|name|data|file|user|type|node|item|list|page|text|time|code|http|your|this|that|with|from|here"


def _count(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, ""))


def dictionary(docs: DataFrame, most: int = DICTIONARY, least_letters: int = LEAST_LETTERS) -> tuple[str, ...]:
    """The ``most`` words of letters alone that most documents hold, counted over all of them."""
    letters = rf"(?<![\p{{L}}\d])\p{{L}}{{{least_letters},24}}+(?![\p{{L}}\d])"
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(letters), F.lit(0))))
    counted = docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return tuple(r.word for r in counted.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect())


def describe(before: Column, found: Column, after: Column, words: Sequence[str] = ()) -> Column:
    """The features of a candidate as a struct of doubles; ``words`` are the dictionary."""
    value = F.regexp_extract(found, _VALUE, 1)
    return features(before, value, after, F.length(value) < F.length(found), words)


def _covered(value: Column, words: Sequence[str]) -> Column:
    """How many characters of ``value`` belong to words: fixed ones anywhere, others as runs of letters."""
    fixed = F.length(value) - F.length(F.regexp_replace(F.lower(value), WORDS, ""))
    if not words:
        return fixed
    parts = F.regexp_extract_all(F.regexp_replace(value, r"(\p{Ll})(\p{Lu})", "$1 $2"), F.lit(r"\p{L}{4,}+"), F.lit(0))
    own = F.filter(F.transform(parts, F.lower), lambda w: w.isin(*words))
    return F.greatest(fixed, F.aggregate(own, F.lit(0), lambda n, w: n + F.length(w)))


def features(before: Column, value: Column, after: Column, named: Column, words: Sequence[str] = ()) -> Column:
    """Length, character classes, transitions, dictionary coverage, path and neighbouring words."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-"), "", "")
    low = F.lower(value)
    near = F.lower(F.concat_ws(" ", before, after))
    flag = lambda c: c.cast("double")
    cols = {
        "length": n,
        "digits": _count(value, "[^0-9]") / n,
        "upper": _count(value, "[^A-Z]") / n,
        "marks": _count(value, "[A-Za-z0-9]") / n,
        "changes": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n,
        "hex": flag(low.rlike("^[0-9a-f-]+$")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        "words": _covered(value, words) / n,
        "vowels": _count(low, "[^aeiou]") / n,
        "path": flag(value.rlike(r"/[a-z]+/|^/|\.[a-z]{2,4}$") | F.lower(before).rlike(r"(https?:|[a-z0-9]/|\\)[^\s]*$")),
        "named": flag(named | F.lower(before).rlike(rf"(?:{NAMES})\W{{0,6}}$")),
        "hash": flag(F.lower(F.substring(before, -24, 24)).rlike(r"\b(commit|sha\d*|md5|checksum|digest|hash|etag|uuid|guid|integrity|revision|build)\W*\w{0,6}\W*$")),
        "sample": flag(low.rlike(r"example|sample|dummy|changeme|placeholder|your|xxxx|\*\*\*\*|redacted|<|\$\{")),
        "secretive": flag(near.rlike(rf"\b(?:{NAMES}|login|deploy|auth\w*|key)\b")),
        "number": flag(value.rlike(r"^[0-9-]+$")),
    }
    return F.struct(*[F.coalesce(c, F.lit(0.0)).cast("double").alias(k) for k, c in cols.items()])


FEATURES = ("length", "digits", "upper", "marks", "changes", "hex", "distinct", "words", "vowels", "path", "named", "hash", "sample", "secretive", "number")


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(before, found, after, label): ``rows`` findings of known kind, made from hashes.

    A bounded set; even kinds are credentials (label 1), odd kinds false positives.
    """
    i = F.col("id")
    hx = lambda k: F.sha2(F.concat_ws("/", i.cast("string"), F.lit(str(k))), 256)
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(hx(k))), "=", "")
    word = lambda k: pick(k, ["config", "version", "update", "index", "page", "user", "table", "string", "object", "image", "state", "query"])
    name = pick("n", ["token", "secret", "password", "api_key", "apikey", "access_key", "passwd", "pwd", "auth_key", "client_secret", "TOKEN", "API_KEY", "SECRET", "PASSWORD"])
    sign = pick("s", [" = \"", "=", ": ", ": \"", " = '", "=\"", "\": \"", " := \""])
    prose = F.concat_ws(" ", F.lit(""), word(1), word(2), F.substring(F.translate(hx(3), "0123456789", "tionasherd"), 1, 9), word(4), F.lit(""))
    kinds = [
        (prose, F.concat(name, sign, F.substring(hx(10), 1, 40)), 1),
        (prose, F.substring(hx(11), 1, 40).cast("string"), 0),
        (prose, F.concat(name, sign, b64(12)), 1),
        (F.concat(prose, pick("h", ["commit ", "sha256:", "md5 ", "checksum: ", "etag \"", "uuid ", "build ", "digest sha1-"])), F.substring(hx(13), 1, 40), 0),
        (prose, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(hx(14), 1, 16), "018", "XYZ"))), 1),
        (prose, F.substring(F.translate(hx(15), "abcdef", "123456"), 1, 16), 0),
        (prose, F.concat(pick("g", ["ghp_", "gho_", "sk-", "xoxb-", "glpat-", "sk_live_"]), F.substring(F.regexp_replace(b64(16), "[+/]", "q"), 1, 36)), 1),
        (F.concat(prose, F.lit("https://")), F.concat(word(5), F.lit("/"), word(6), F.lit("/"), F.substring(hx(17), 1, 8), F.lit("-"), word(7)), 0),
        (prose, F.concat(name, sign, F.substring(F.regexp_replace(b64(18), "[+/]", "Z"), 1, 12), F.lit("9!")), 1),
        (prose, F.concat(name, sign, pick("p", ["your_token_here", "example-secret-1", "changeme123", "xxxxxxxxxxxx", "${TOKEN}", "************", "placeholder_1", "<redacted-key1>", "undefined", "process.env.TOKEN", "getToken(user)", "dummy_password1"])), 0),
        (prose, F.concat(name, sign, F.upper(F.substring(hx(20), 1, 40))), 1),
        (prose, F.concat(word(8), pick("d", ["_", "-"]), word(9), pick("d", ["_", "-"]), word(10), pick("d", ["_", "-"]), F.substring(F.translate(hx(21), "abcdef", "123456"), 1, 4)), 0),
        (F.concat(prose, F.lit("Authorization: Bearer ")), F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9"), b64(22)), 1),
        (prose, F.concat_ws("-", F.substring(hx(23), 1, 8), F.substring(hx(23), 9, 4), F.substring(hx(23), 13, 4), F.substring(hx(23), 17, 4), F.substring(hx(23), 21, 12)), 0),
        (prose, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64(24), b64(25), F.lit("\n-----END RSA PRIVATE KEY-----")), 1),
        (prose, F.concat(F.translate(F.substring(hx(26), 1, 14), "0123456789", "tionasherd"), F.lit("2"), F.translate(F.substring(hx(27), 1, 6), "0123456789", "tionasherd")), 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    choose = lambda part: F.coalesce(*[F.when(kind == k, part(x)) for k, x in enumerate(kinds)])
    after = F.concat(F.when(choose(lambda x: x[1]).rlike("[\"'](?:.|\n)*$"), F.lit("\" ")).otherwise(F.lit(" ")), word(30), F.lit(" "), word(31))
    made = spark.range(0, rows, 1, 2).select(choose(lambda x: x[0]).alias("before"), choose(lambda x: x[1]).alias("found"), after.alias("after"), choose(lambda x: F.lit(x[2])).alias("label"))
    return cut(made, "findings")


@dataclass
class Forest:
    """Trees as nested tuples: (feature, cut, left, right), or the share of label 1; and the dictionary."""

    trees: list
    words: tuple[str, ...] = ()

    def score(self, f: Column) -> Column:
        """The mean share over all trees, as an expression over the features' struct."""

        def grow(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, at, left, right = node
            return F.when(f[name] <= at, grow(left)).otherwise(grow(right))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + grow(t)
        return total / float(max(1, len(self.trees)))


#: Trees, levels, cuts tried of each feature, and features tried at each node.
TREES, DEPTH, CUTS, TRIED = 12, 6, 16, 5


def train(findings: DataFrame, words: Sequence[str] = (), trees: int = TREES, depth: int = DEPTH, cuts: int = CUTS, tried: int = TRIED) -> Forest:
    """A forest from labelled findings, whatever their number: each level is one aggregation to
    counts by (tree, node, feature, bin), which alone reach the driver."""
    raw = cut(findings.where(F.col("label").isin(0, 1)).select(describe(F.coalesce("before", F.lit("")), F.coalesce("found", F.lit("")), F.coalesce("after", F.lit("")), words).alias("f"), F.col("label").cast("double").alias("y"), F.xxhash64("before", "found", "after").alias("h")), "features")
    grid = [i / cuts for i in range(1, cuts)]
    found = raw.agg(*[F.percentile_approx(f"f.{n}", grid, 1000).alias(n) for n in FEATURES]).first()
    edges = {n: sorted(set(found[n] or [])) for n in FEATURES}

    def bin_of(n: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges[n]]), lambda e: e < F.col(f"f.{n}"))) if edges[n] else F.lit(0)

    # a row's weight in a tree: how often the bootstrap drew it (Poisson of mean 1, from a hash)
    draw = lambda t: F.pmod(F.xxhash64("h", F.lit(t)), F.lit(10000))
    weight = lambda t: F.when(draw(t) < 3679, 0).when(draw(t) < 7358, 1).when(draw(t) < 9197, 2).otherwise(3)
    binned = cut(raw.select(F.array(*[bin_of(n) for n in FEATURES]).alias("b"), "y", F.array(*[weight(t) for t in range(trees)]).alias("w")), "binned")

    import random

    rng = random.Random(17)
    built: dict[tuple[int, int], object] = {}
    open_: dict[tuple[int, int], list] = {(t, 1): [] for t in range(trees)}  # node to the cuts above it
    rows = binned.select("b", "y", F.posexplode("w").alias("t", "k")).where("k > 0").withColumn("node", F.lit(1))
    for level in range(depth + 1):
        if not open_:
            break
        if level:  # each row goes on to a child; the cuts of one level are at most trees * 2 ** depth rows
            cut_rows = [(t, node, FEATURES.index(c[0]), c[2]) for (t, node), c in built.items() if isinstance(c, tuple) and node >> (level - 1) == 1]
            table = findings.sparkSession.createDataFrame(cut_rows, "t int, node int, i int, bin int")
            rows = rows.join(F.broadcast(table), ["t", "node"]).select("b", "y", "t", "k", (F.col("node") * 2 + F.when(F.get("b", "i") <= F.col("bin"), 0).otherwise(1)).alias("node"))
        counted = rows.select("t", "node", "y", "k", F.posexplode("b").alias("i", "bin")).groupBy("t", "node", "i", "bin").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("y")).alias("p"))
        got: dict[tuple[int, int], dict[int, dict[int, tuple[float, float]]]] = {}
        for r in counted.orderBy("t", "node", "i", "bin").collect():
            got.setdefault((r.t, r.node), {}).setdefault(r.i, {})[r.bin] = (float(r.n), float(r.p))
        after: dict[tuple[int, int], list] = {}
        for key in sorted(open_):
            bins = got.get(key, {})
            n, p = (sum(x) for x in zip(*bins[0].values(), strict=True)) if bins else (0.0, 0.0)
            split = None
            if level < depth and 0 < p < n and n >= 8:
                best = 1e-9
                gini = lambda n, p: p * (n - p) / n if n else 0.0
                for i in sorted(rng.sample(range(len(FEATURES)), tried)):
                    ln = lp = 0.0
                    for b in sorted(bins.get(i, {}))[:-1]:
                        ln, lp = ln + bins[i][b][0], lp + bins[i][b][1]
                        gain = gini(n, p) - gini(ln, lp) - gini(n - ln, p - lp)
                        if gain > best and min(ln, n - ln) >= 2:
                            best, split = gain, (FEATURES[i], edges[FEATURES[i]][b], b)
            built[key] = split if split else (p + 0.5) / (n + 1.0)
            if split:
                after |= {(key[0], 2 * key[1]): [], (key[0], 2 * key[1] + 1): []}
        open_ = after

    def tree(t: int, node: int):
        at = built.get((t, node), 0.5)
        return at if isinstance(at, float) else (at[0], at[1], tree(t, 2 * node), tree(t, 2 * node + 1))

    discard(raw, binned)
    return Forest([tree(t, 1) for t in range(trees)], tuple(words))


def _split(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and the pieces around them (one more)."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _described(found: Column, rest: Column) -> Column:
    """A struct of ordinal, found and its contexts for each candidate."""
    return F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(i.alias("ordinal"), F.substring(F.get(rest, i), -CONTEXT, CONTEXT).alias("before"), F.get(found, i).alias("found"), F.substring(F.get(rest, i + 1), 1, CONTEXT).alias("after")))


def findings(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """(doc_id, ordinal, kind, length, secret_sha256, score, secret) of every candidate: the digest
    of its value, the forest's score and whether that reaches ``threshold``."""
    found, rest = _split(F.col("text"))
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE)).select("doc_id", found.alias("found"), rest.alias("rest"))
    one = rows.select("doc_id", F.explode(_described(F.col("found"), F.col("rest"))).alias("c")).select("doc_id", "c.*")
    value = F.regexp_extract("found", _VALUE, 1)
    kind = F.when(F.col("found").startswith("-----BEGIN"), "private key").when(F.length(value) < F.length("found"), "assignment").otherwise("token")
    scored = one.select("doc_id", "ordinal", kind.alias("kind"), F.length(value).alias("length"), F.sha2(value, 256).alias("secret_sha256"), describe(F.col("before"), F.col("found"), F.col("after"), forest.words).alias("f"))
    return scored.select("doc_id", "ordinal", "kind", "length", "secret_sha256", forest.score(F.col("f")).alias("score")).withColumn("secret", F.col("score") >= threshold)


def redacted(docs: DataFrame, forest: Forest, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with ``mask`` in place of each secret's value; ``n_chars`` follows."""
    found, rest = _split(F.col("text"))

    def cleaned(c: Column) -> Column:
        value = F.regexp_extract(c["found"], _VALUE, 1)
        name = F.substring(c["found"], F.lit(1), F.length(c["found"]) - F.length(value))
        # the inner transform binds the features, so that each is computed once
        score = F.get(F.transform(F.array(describe(c["before"], c["found"], c["after"], forest.words)), forest.score), F.lit(0))
        return F.when(score >= threshold, F.concat(name, F.lit(mask))).otherwise(c["found"])

    parts = docs.withColumns({"__found": F.when(F.col("text").rlike(CANDIDATE), found), "__rest": F.when(F.col("text").rlike(CANDIDATE), rest)})
    new = F.transform(_described(F.col("__found"), F.col("__rest")), cleaned)
    joined = F.array_join(F.zip_with("__rest", new, lambda r, n: F.concat(r, F.coalesce(n, F.lit("")))), "")
    text = F.when(F.col("__found").isNotNull(), joined).otherwise(F.col("text"))
    out = parts.withColumn("text", text).drop("__found", "__rest")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
