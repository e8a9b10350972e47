"""HTML extraction: a recurrent block labeller.

A page is read as a sequence of blocks: the runs of text between the tags that open or close
block-level elements. Each block has a vector of hashed features of its tag path (names of the open
elements and of their classes and ids, with inherited and own places apart), of its hashed words,
and of its shape. A bidirectional LSTM in numpy reads the whole sequence, so the label of each
block depends on all others, and the blocks labelled as content make up the text.

The labeller is trained here on pages made by a generator: articles in varied templates between
menus, banners, sidebars, notices, adverts, forms, comments and footers, with the tags and class
names in use for each. No page of the corpus is needed for training.

Defined results: null and empty html, and pages without content, give an empty text; text outside any
body element counts as body text; unclosed elements end with their parent or, where HTML says
so, with the next sibling; comments, scripts, styles, drawings, form fields and markup are never text, formulas
and what an object falls back to are; character
references are decoded once; repeated rows are extracted alike; pages of any length are read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import map_batches

#: Lengths of the path, word and shape parts of a block's vector, and of the state of a direction.
PATH, WORDS, SHAPE, STATE = 96, 24, 8, 16
_SIZE = PATH + WORDS + SHAPE
#: Blocks, with padding, that are labelled at a time.
CELLS = 1 << 14
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "head", "select"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var button object math mi mn mo mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics annotation".split())
#: Elements that an opening tag of the same group ends, up to the nearest of the bounds.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = frozenset(("ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "aside", "nav"))
_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_BODY = re.compile(r"<body\b", re.I)
_NAMES = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]  # open block elements: name, and words of class, id and role
    text: str
    linked: int  # characters within links


def blocks(html: str | None) -> list[Block]:
    """The page's blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0
    at, page = 0, html or ""
    path: tuple = ()

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            parts, linked = [], 0

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in _INLINE:
                continue
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        elif name in _RAW:
            end = _CLOSING[name].search(page, at)
            if end is None and name == "head":
                end = _BODY.search(page, at)
                at = end.start() if end else len(page)
            elif not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            if name not in ("svg", "select", "textarea", "iframe"):
                close()
            continue
        elif name in _VOID:
            if name == "hr":
                close()
            continue
        elif name in _INLINE:
            if name == "a":
                links += 1
            continue
        else:
            close()
            if stack and stack[-1][0] == "p":
                stack.pop()  # a block element ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _ENDS.get(name, ()):
                    del stack[i:]
                    break
                if stack[i][0] in _BOUNDS:
                    break
            words: list[str] = []
            if m[3]:
                for a in _NAMES.finditer(m[3]):
                    words += [w.lower() for w in _TOKENS.findall(a[2] or a[3] or a[4] or "")]
                if _HIDDEN.search(m[3]):
                    words.append("hidden")
            stack.append((name, tuple(words)))
        path = tuple(x for x in stack if x[0] not in ("html", "body"))
    close()
    return out


_hashes: dict[tuple[str, int], tuple[int, float]] = {}


def _place(word: str, size: int) -> tuple[int, float]:
    found = _hashes.get((word, size))
    if found is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        found = _hashes[word, size] = (h % size, 1.0 if h >> 31 else -1.0)
    return found


def vectors(page: list[Block]) -> np.ndarray:
    """(blocks, size): path, words and shape of each block."""
    x = np.zeros((len(page), _SIZE))
    for row, b in zip(x, page, strict=True):
        for depth, (name, words) in enumerate(reversed(b.path)):
            row[_place(name, PATH)[0]] = 1.0
            if depth == 0:
                row[_place("own " + name, PATH)[0]] = 1.0
            for w in words:
                row[_place("." + w, PATH)[0]] = 1.0
        found = _WORD.findall(b.text.lower())
        for w, times in Counter(found).items():
            i, sign = _place(w, WORDS)
            row[PATH + i] += sign * times
        if found:
            row[PATH : PATH + WORDS] /= np.sqrt(len(found)) * 2
        n = len(b.text)
        row[PATH + WORDS :] = (np.log1p(n) / 6, b.linked / n, n < 25, n > 120, b.text[-1] in ".!?…\"”", "©" in b.text or "@" in b.text, len(b.path) / 8, 1.0)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"{d}x"] = rng.normal(0, 1 / np.sqrt(_SIZE), (_SIZE, 4 * STATE))
            self.p[f"{d}h"] = rng.normal(0, 1 / np.sqrt(STATE), (STATE, 4 * STATE))
            self.p[f"{d}b"] = np.concatenate([np.ones(STATE), np.zeros(3 * STATE)])
        self.p["x"], self.p["o"], self.p["c"] = np.zeros(_SIZE), rng.normal(0, 0.3, 2 * STATE), np.zeros(1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, learns: bool = True) -> tuple[np.ndarray, list]:
        """States (time, pages, STATE), and what gradients need; masked steps leave the state as it was."""
        t, n, _ = x.shape
        z = x.reshape(t * n, -1) @ self.p[f"{d}x"] + self.p[f"{d}b"]
        z = z.reshape(t, n, -1)
        h, c = np.zeros((n, STATE)), np.zeros((n, STATE))
        out, kept = np.zeros((t, n, STATE)), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[k] + h @ self.p[f"{d}h"]
            f, i, o = (_sigmoid(a[:, j * STATE : (j + 1) * STATE]) for j in range(3))
            g = np.tanh(a[:, 3 * STATE :])
            m = mask[k][:, None]
            c1 = f * c + i * g
            th = np.tanh(c1)
            if learns:
                kept.append((k, h, c, f, i, o, g, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c1, c)
            out[k] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray, learns: bool = True) -> tuple[np.ndarray, tuple]:
        f, b = self._run("f", x, mask, learns), self._run("b", x, mask, learns)
        both = np.concatenate([f[0], b[0]], axis=2)
        return both @ self.p["o"] + x @ self.p["x"] + self.p["c"][0], (both, f[1], b[1])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (both, *runs) = self.logits(x, mask)
        e = np.where(mask, _sigmoid(z) - y, 0.0) / mask.sum()
        g = {"o": np.einsum("tn,tns->s", e, both), "x": np.einsum("tn,tns->s", e, x), "c": np.array([e.sum()])}
        for d, kept, own in zip("fb", runs, (self.p["o"][:STATE], self.p["o"][STATE:]), strict=True):
            wh = self.p[f"{d}h"]
            da = np.zeros((*x.shape[:2], 4 * STATE))
            gh, dh, dc = np.zeros_like(wh), np.zeros((x.shape[1], STATE)), np.zeros((x.shape[1], STATE))
            for k, h, c, f, i, o, gg, th, m in reversed(kept):
                dh = dh + e[k][:, None] * own
                dct = dc + dh * o * (1 - th**2)
                a = np.concatenate([dct * c * f * (1 - f), dct * gg * i * (1 - i), dh * th * o * (1 - o), dct * i * (1 - gg**2)], axis=1) * m
                da[k] = a
                gh += h.T @ a
                dh, dc = np.where(m, a @ wh.T, dh), np.where(m, dct * f, dc)
            flat = da.reshape(-1, 4 * STATE)
            g[f"{d}x"], g[f"{d}h"], g[f"{d}b"] = x.reshape(-1, _SIZE).T @ flat, gh, flat.sum(axis=0)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 14, size: int = 48, seed: int = 5) -> Labeller:
        """Adam over pages of (vectors, labels)."""
        rng = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), size):
                some = [pages[i] for i in order[k : k + size]]
                x, mask = padded([v for v, _ in some])
                y = np.zeros(mask.shape)
                for j, (_, labels) in enumerate(some):
                    y[: len(labels), j] = labels
                g, t = self.gradients(x, mask, y), t + 1
                for name in self.p:
                    d = g[name] + 1e-5 * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * d
                    s[name] = 0.99 * s[name] + 0.01 * d * d
                    self.p[name] = self.p[name] - 0.015 * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]], size: int = 64, cells: int = CELLS) -> list[np.ndarray]:
        """For each page, which of its blocks are content; pages of like length run together, at most
        ``size`` and, a long page alone aside, at most ``cells`` blocks with their padding."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            n = 1
            while n < min(size, len(order)) and (n + 1) * len(pages[order[n]]) <= cells:
                n += 1
            own, order = order[:n], order[n:]
            x, mask = padded([vectors(pages[i]) for i in own])
            z, _ = self.logits(x, mask, learns=False)
            for j, i in enumerate(own):
                out[i] = z[: len(pages[i]), j] > 0
        return out


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, pages, size) and which steps are real."""
    t = max(len(s) for s in seqs)
    x, mask = np.zeros((t, len(seqs), _SIZE)), np.zeros((t, len(seqs)), dtype=bool)
    for j, s in enumerate(seqs):
        x[: len(s), j] = s
        mask[: len(s), j] = True
    return x, mask


#: What surrounds an article: openings in use for each kind of block, and what they hold.
_AROUND = {
    "menu": ("nav", "nav class=menu", 'div class="nav"', 'div id="menu"', 'ul class="nav-menu"', 'div class="navbar"', 'div class="breadcrumbs"', 'nav role="navigation"', 'div class="main-navigation"', 'div class="topnav"', 'ul class="menu"', 'div class="breadcrumb"'),
    "top": ("header", 'div class="header"', 'div id="header"', 'header class="site-header"', 'div class="masthead"', 'div class="banner"', 'div role="banner"', 'div class="page-header"', 'div id="top"', 'div class="branding"', 'div class="logo"'),
    "side": ("aside", 'div class="sidebar"', 'aside class="widget"', 'div id="sidebar"', 'div class="related-posts"', 'section class="related"', 'div class="recommended"', 'div class="widget"', 'div class="share"', 'div class="social"', 'div class="author-box"', 'div class="tags"', 'aside class="sidebar"', 'div class="trending"', 'div class="popular"'),
    "notice": ('div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="consent"', 'div class="alert"', 'div class="popup"', 'div class="modal"', 'div class="cookie"', 'section class="gdpr-banner"', 'div role="alert"', 'div class="notification"', 'div role="dialog"'),
    "ad": ('div class="ad"', 'div class="ads"', 'div class="advert"', 'aside class="ad"', 'div id="ad-top"', 'div class="sponsored"', 'div class="promo"', 'section class="advertisement"', 'div class="ad-slot"', 'ins class="adsbygoogle"', 'div class="sponsor"'),
    "form": ("form", 'form class="search"', 'div class="newsletter"', 'form id="subscribe"', 'div class="signup"', 'div class="login"', 'form class="contact-form"', 'div class="search"', 'fieldset', 'div class="subscribe"'),
    "comments": ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="comment"', 'div id="disqus"', 'section class="comments"', 'ul class="commentlist"', 'div class="reader-comments"', 'div class="replies"', 'div class="discussion"'),
    "foot": ("footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="legal"', 'div class="bottom"', 'footer class="page-footer"'),
}
_ARTICLE = ("article", "main", "main|article", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="article-body"', 'div class="entry-content"', 'section class="story"', 'div class="text"', 'div id="main"', 'main|div class="content"', 'div class="wrapper"|article', 'div role="main"', 'article class="post"|div class="body"')
_SYLLABLES = ("er", "an", "th", "on", "in", "re", "ti", "es", "en", "he", "ment", "eau", "tion", "sch", "ung", "ich", "ou", "que", "ó", "ción", "os", "ar", "é", "ü", "ß", "ñ", "la", "do", "ble", "ing", "ver", "ter")


def sample_page(rng: np.random.Generator, part: int | None = None) -> list[tuple[str, bool]]:
    """An invented page as (html piece, whether text in it is content); ``part`` 0 or 1 takes every second
    opening only, so that templates can be held out."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    mark = pick(("", "", "", "", " |", "***", "!!", ",", "&amp;&amp;&amp;"))
    say = lambda a, b: " ".join(word() + mark for _ in range(int(rng.integers(a, b)))).capitalize() + pick((".", ".", ".", "", "!", "?"))
    ends = lambda opening: "</" + opening.split()[0] + ">"

    def around(kind: str) -> list[tuple[str, bool]]:
        opening = pick(_AROUND[kind] if part is None else _AROUND[kind][part::2])
        items: list[str] = []
        for _ in range(int(rng.integers(1, 6))):
            items.append({
                "menu": lambda: f'<li><a href="#">{say(1, 3)}</a></li>' if rng.random() < 0.7 else f'<a href="#">{word()}</a>',
                "top": lambda: pick(("<div>%s</div>", "<p>%s</p>", "<h2>%s</h2>", '<h1><a href="/">%s</a></h1>', "<span>%s</span>")) % say(1, 8),
                "side": lambda: pick(("<h3>%s</h3>", "<p>%s</p>", '<li><a href="#">%s</a></li>', "<div>%s</div>", "%s")) % say(2, 20),
                "notice": lambda: pick(("<p>%s</p>", "%s", "<div>%s</div>", "<button>%s</button>")) % say(3, 25),
                "ad": lambda: pick(("%s", "<p>%s</p>", '<a href="#">%s</a>')) % say(3, 25),
                "form": lambda: pick(("<label>%s</label>", "<p>%s</p>", "<button>%s</button>", "<legend>%s</legend>", "%s <input>")) % say(1, 10),
                "comments": lambda: pick(("<p>%s</p>", "<li>%s</li>", '<div class="comment"><p>%s</p></div>', "<h3>%s</h3>")) % say(3, 50),
                "foot": lambda: pick(("%s", "<p>%s</p>", '<a href="#">%s</a>', "&copy; example.com &middot; %s", "<li>%s</li>")) % say(1, 20),
            }[kind]())
        if kind in ("menu", "ad", "foot", "notice") and rng.random() < 0.5:
            items = [f"<ul>{''.join(items)}</ul>"] if kind == "menu" else items[:1]
        return [(f"<{opening}>" + "".join(items) + ends(opening), False)]

    def article() -> list[tuple[str, bool]]:
        wraps = pick(_ARTICLE if part is None else _ARTICLE[part::2]).split("|")
        if part is None and rng.random() < 0.35:
            wraps = ["article"]
        out = [("".join(f"<{w}>" for w in wraps), True)]
        if rng.random() < 0.8:
            out.append((pick(("<h1>%s</h1>", "<h1>%s</h1>", '<h2 class="title">%s</h2>', '<header><h1>%s</h1></header>')) % say(2, 12), True))
        for _ in range(int(rng.integers(0, 14))):
            kind = rng.random()
            if kind < 0.06:
                out += around(pick(("ad", "side", "notice", "form")))
            elif kind < 0.7:
                body = say(1, 90) if rng.random() < 0.8 else say(1, 3)
                out.append((pick(("<p>%s</p>", "<p>%s</p>", "<p>%s", "<p><b>%s<br>", "<p>%s <a href='#'>" + word() + "</a></p>", "<p><em>%s</em></p>", '<p class="lead">%s</p>')) % body, True))
            else:
                out.append((pick(("<h2>%s</h2>", "<h3>%s</h3>", "<ul><li>%s</li></ul>", "<blockquote><p>%s</p></blockquote>", "<pre>%s</pre>", "<table><tr><td>%s</td></tr></table>", "<figure><figcaption>%s</figcaption></figure>", "<div>%s</div>", "<section><p>%s</p></section>", "<ol><li>%s</li></ol>")) % say(2, 40), True))
        return [*out, ("".join(ends(w) for w in reversed(wraps)), True)]

    parts: list[tuple[str, bool]] = []
    for kind in ("notice", "top", "menu", "ad", "side"):
        if rng.random() < (0.7 if kind == "menu" else 0.4):
            parts += around(kind)
    parts += article()
    for kind in ("side", "ad", "form", "comments", "notice", "menu", "foot"):
        if rng.random() < (0.75 if kind == "foot" else 0.35):
            parts += around(kind)
    if rng.random() < 0.3:
        parts = [('<div class="container">', False), *parts, ("</div>", False)]
    return parts


def sample(rng: np.random.Generator, part: int | None = None) -> tuple[list[Block], np.ndarray]:
    """The blocks of an invented page and their labels."""
    parts = sample_page(rng, part)
    page = "".join(h for h, _ in parts)
    found = blocks(page)
    # each piece of text is told apart by where its blocks end up when pieces are marked
    marked = blocks("".join(re.sub(r">([^<>]*\w[^<>]*)(?=<|$)", lambda m, c=c: ">" + ("\x01" if c else "\x02") + m[1], h) for h, c in parts))
    labels = np.array(["\x01" in b.text for b in marked], dtype=float)
    return (found, labels) if len(found) == len(labels) else sample(rng, part)


_trained: dict[tuple, Labeller] = {}


def train(pages: int = 600, seed: int = 3, part: int | None = None) -> Labeller:
    """A labeller from ``pages`` invented pages; kept for the process."""
    if (pages, seed, part) not in _trained:
        rng = np.random.default_rng(seed)
        _trained[pages, seed, part] = Labeller().fit([(vectors(b), y) for b, y in (sample(rng, part) for _ in range(pages)) if b])
    return _trained[pages, seed, part]


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """The main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: list[str] = []
        found = [blocks(h) for h in batch.column("html").to_pylist()]
        kept = shared.value.label(found)
        texts += ["\n".join(b.text for b, ok in zip(p, y, strict=True) if ok) for p, y in zip(found, kept, strict=True)]
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(pages.select("page_id", "url", "html"), run, SCHEMA)
