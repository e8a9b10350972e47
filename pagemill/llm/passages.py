"""Substring dedup: compact windows.

A text is the sequence of its five-word shingles. Under each of a few min-hash functions the top
of the Cartesian tree over the shingles' hashes is walked: a node whose span holds at least one
passage of the least length is a compact window, standing for all passages of its span that hold
the node's shingle and thus share its signature. Windows of equal signature are joined, their
intervals aligned at the common shingle, and pairs of texts whose aligned intervals overlap under
enough signatures are verified on the shingles themselves.

Each window is filed three times: under its centre's shingle alone, which near copies share
wherever words are put in or left out, and, to make signatures selective, with the shingle half a
passage before its centre and with the one half a passage after; any exact repeat of the least
length holds one of the two. A task shuffles them in blobs, one for each part of the keys, not row by row. Near copies of similarity s share a centre under one of n functions in
a share of 1 - (1 - s) ** n of all cases. Each map task links the members of a large group that it holds
itself and passes on a few, so that a signature of any frequency reaches the shuffle as a few rows of each
task; members are linked to the group's least id, never all with all. ``enough`` says how many of a pair's
signatures (three of each function) must agree; it is one, since near copies may share a single centre
and every link is verified on the shingles themselves.

A signature is also shared by texts that have less than a passage in common, so a member need not
repeat the least id's passage but may repeat another member's. If a member's link is not verified
around the window's centre, all members of the signature, the least id and the verified ones too (but for
those that go on as the least id does, as far as any passage with the centre can reach), meet again in two ways. They are filed under the hash of each whole passage of the least length that holds
the centre: texts of equal key there have equal passages, and the least id stands for all, however
many members there are. And what surrounds the centre is compared with several leaders: each member joins the
first leader whose surroundings share a passage with its own, and leads itself where none does, so that near
copies find each other beside texts that have a part of the passage. Groups of more than ``MEET``
members are dealt by min-hashes of what lies before, around and after the centre to smaller ones,
``DEALINGS`` times each. Those that find no leader there, and whose surroundings hold enough that another one
of the group holds, are compared with each other after that, in blocks that meet two by two, so no member of a
group of any size is left out.

A row is told apart by its id, or, where that is null or occurs again, by its place in the stored files.
All places of a key in a text are filed, so a second copy of a passage is found too; places closer to
each other than a passage are one run, filed at its first, whose window reaches over it.

Defined results: null and empty texts and texts of fewer words than a passage have no window; equal
texts are linked over their whole length; rows of one id are texts of their own, so a row may name the same
id twice; rows without id come after all others and are reported without it; an empty table gives an empty
result; other columns are ignored. Texts of any length are read whole. Repeats within one text alone are
not reported.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ROW, SLICE, cut, discard, heavy_join, map_batches, mix, partitions, run_hashes, shingles_of, text_slices, with_rows

#: Words of a shingle and of the shortest passage, hash functions, signatures (three of each
#: function) that must agree, similarity of verified passages.
WIDTH, LEAST_WORDS, FUNCTIONS, ENOUGH, THRESHOLD = 5, 50, 3, 1, 0.8
#: Members of a task's group that are passed on; rows after which a task passes its groups on.
PASSED, FLUSH = 6, 1 << 20
#: Bytes of stored input of which a task holds the filed keys at a time, and the parts that such keys go to at most for it.
PART, PARTS = 8 << 20, 1 << 14
#: Members that are compared with each other's leaders in one task, shingles on either side of a centre
#: that are compared, and min-hashes by which larger groups are dealt.
MEET, AROUND, DEALINGS = 512, 64, 1
_SIDE = 16
_SIDES = (1 << _SIDE) - 1
#: Slots of signatures that are a centre's shingle alone.
ALONE = sum(1 << k for k in range(2, 16, 3))
#: Bytes of a shingle's hash that are stored for verification. Two texts of a million shingles each have one in common
#: by chance in one of 280 cases, and a passage takes dozens.
KEPT = 6
#: What a reach of ``_SIDES`` or more stands for: more shingles than a text has.
_FAR = 1 << 26


def windows(v: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(begin, centre, end) of the Cartesian tree's nodes over ``v`` that span ``least`` or more."""
    out, open_ = [], [(0, len(v))] if len(v) >= least else []
    while open_:
        a, b = open_.pop()
        c = a + int(v[a:b].argmin())
        out.append((a, c, b))
        if c - a >= least:
            open_.append((a, c))
        if b - c > least:
            open_.append((c + 1, b))
    return out


def _sliding(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """``f``, the lesser or the greater one, over each ``n`` values in a row."""
    out, m = x, 1
    while 2 * m <= n:
        out, m = f(out[:-m], out[m:]), 2 * m
    return out if m == n else f(out[: len(x) - n + 1], out[n - m :])


def windows_of(v: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``windows`` of all runs of ``v``, each of ``least`` values or more, that begin at ``begin``, whose last is the
    end: runs, and begins, centres and ends as places in ``v``.

    A node's span holds ``least`` values if it is the least one, the first of equal ones, of so many in a row. So the least
    values of all such rows are looked for, and each one's span ends at the nearest lesser ones: these are nodes too."""
    low = np.zeros(len(v) + least - 1, dtype=np.uint64)
    low[least - 1 : len(v)] = _sliding(v, least, np.minimum)
    low[(begin[1:-1, None] + np.arange(least - 1)).ravel()] = 0  # rows that reach into the next run
    at = np.flatnonzero(_sliding(low, least, np.maximum) == v)
    first = np.searchsorted(at, begin)
    run = np.repeat(np.arange(len(begin) - 1), np.diff(first))
    # a stop stands before each run, and after the last one
    own, stops = np.arange(len(at)) + run + 1, first + np.arange(len(begin))
    place, value, stop = np.empty(len(at) + len(begin), dtype=np.int64), np.zeros(len(at) + len(begin), dtype=np.uint64), np.ones(len(at) + len(begin), dtype=bool)
    place[own], place[stops], value[own], stop[own] = at, begin, v[at], False

    def nearest(step: int, passed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        to, left = np.arange(len(place)) + step, own
        while len(left):
            x = to[left]
            left = left[~stop[x] & passed(value[x], value[left])]
            to[left] = to[to[left]]  # what lies up to there is passed as well
        return to[own]

    before, after = nearest(-1, np.greater), nearest(1, np.greater_equal)
    a, b = place[before] + ~stop[before], place[after]
    ok = b - a >= least
    return run[ok], a[ok], at[ok], b[ok]


def signatures(h: np.ndarray, begin: np.ndarray, functions: int = FUNCTIONS, least: int = LEAST_WORDS - WIDTH + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, texts and packed (centre, reach before, reach after, slot) of the windows of all texts whose shingles
    ``h`` are; they begin at ``begin``, whose last is the end."""
    size = np.diff(begin)
    texts = np.flatnonzero(size >= least)
    if not len(texts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h, n = h[np.repeat(size >= least, size)], int(size[texts].sum())
    begin = np.append(0, np.cumsum(size[texts]))
    seeds = np.array([(f + 1) * 0xA24BAED4963EE407 % (1 << 64) for f in range(functions)], dtype=np.uint64)
    v = mix(h[None, :] ^ seeds[:, None]).ravel()
    run, a, c, b = windows_of(v, np.append((np.arange(functions)[:, None] * n + begin[:-1]).ravel(), functions * n), least)
    f, text = run // len(texts), run % len(texts)
    place = c - f * n - begin[text] << (2 * _SIDE + 4) | np.minimum(c - a, _SIDES) << (_SIDE + 4) | np.minimum(b - 1 - c, _SIDES) << 4 | 3 * f
    centre, half = v[c] * np.uint64(3), least // 2
    keys, of, packed = [centre + np.uint64(2)], [text], [place + 2]
    for side, at in enumerate((c - half, c + least - half - 1)):
        ok = (at >= a) & (at < b)
        keys.append(centre[ok] + h[at[ok] - f[ok] * n] + np.uint64(side))
        of.append(text[ok])
        packed.append(place[ok] + side)
    keys, of, packed = mix(np.concatenate(keys)), texts[np.concatenate(of)], np.concatenate(packed)
    # a text that repeats a few words over and over files their key once: the first window reaches over the run
    order = _ordered(keys, of, packed)
    keys, of, packed = keys[order], of[order], packed[order]
    at = packed >> (2 * _SIDE + 4)
    new = np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]) | (at[1:] - at[:-1] >= least))
    return keys[new], of[new], packed[new]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return start, np.diff(np.append(start, len(key)))


def _ordered(key: np.ndarray, node: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The order by key, node and packed; most keys occur once."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    several = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(key) else order
    at = order[several]
    order[several] = at[np.lexsort((packed[at], node[at], key[at]))]
    return order


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """The part, of so many, of each key: parts are ranges of keys."""
    return ((key >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _planes(cols: list[np.ndarray]) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on, of each column: high ones are the same."""
    out = np.empty((8 * len(cols), len(cols[0])), dtype=np.uint8)
    for i, x in enumerate(cols):
        out[8 * i : 8 * i + 8] = x.view(np.uint8).reshape(-1, 8).T
    return out


def _columns(texts: list[bytes], n: int) -> np.ndarray:
    """The ``n`` columns of numbers that planes of bytes are."""
    planes = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(8 * n, -1) for x in texts], axis=1)
    return planes.reshape(n, 8, -1).transpose(0, 2, 1).copy().view(np.int64)[..., 0]


def _file(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """What a task passes on of the (keys, nodes, packed) that it has ``held``, for each part of the keys: the first
    members of each key, and large groups' others in pairs with the first."""
    key, node, packed = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = _ordered(key, node, packed)
    start, size = _runs(key[order])
    place = np.arange(len(key)) - np.repeat(start, size)
    beyond = place >= PASSED
    near, far, first = order[~beyond], order[beyond], order[np.repeat(start, size)[beyond]]
    own = _part(mix(key[far] ^ mix(node[far].view(np.uint64))), parts)
    by_part = np.argsort(own, kind="stable")
    own, far, first = own[by_part], far[by_part], first[by_part]
    ends = [np.searchsorted(x, np.arange(parts + 1)) for x in (_part(key[near], parts), own)]
    planes = _planes([key[near], node[near], packed[near]]), _planes([key[far], node[far], packed[far], node[first], packed[first]])
    del key, node, packed, order, near, place
    full = np.flatnonzero((ends[0][1:] > ends[0][:-1]) | (ends[1][1:] > ends[1][:-1]))
    blobs = [pa.array([x[:, e[k] : e[k + 1]].tobytes() for k in full], pa.binary()) for x, e in zip(planes, ends, strict=True)]
    return pa.record_batch([pa.array(full), *blobs], names=["part", "near", "far"])


def equal_passage(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, int, int, int] | None:
    """(x0, x1, y0, y1) of the first stretch of ``least`` or more shingles that both have, if any."""
    if min(len(x), len(y)) < least:
        return None
    kx, ky = (run_hashes(h.astype(np.uint64), np.arange(len(h) - least + 1), least) for h in (x, y))
    at = np.flatnonzero(np.isin(kx, ky))
    if not len(at):
        return None
    i, j = int(at[0]), int(np.flatnonzero(ky == kx[at[0]])[0])
    n = min(len(x) - i, len(y) - j)
    differ = np.flatnonzero(x[i : i + n] != y[j : j + n])
    n = int(differ[0]) if len(differ) else n
    return (i, i + n, j, j + n)


def whole_passages(h: np.ndarray, centres: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and packed places of all passages of ``least`` shingles that hold one of ``centres``."""
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(centres - least + 1, 0), 1)
    np.add.at(edge, centres + 1, -1)
    begin = np.flatnonzero(np.cumsum(edge[: max(0, len(h) - least + 1)]))
    return run_hashes(h, begin, least), begin << (2 * _SIDE + 4) | (least - 1) << 4


FILED = "part long, near binary, far binary"


def _filing(file: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], parts: int):
    """Batches to what a task files: (keys, nodes, packed) that ``file`` gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for own in file(batch):
                held.append(own)
                n += len(own[0])
                if n >= FLUSH:
                    n = 0
                    yield _file(held, parts)
        if n:
            yield _file(held, parts)

    return run


def parts_of(df: DataFrame) -> int:
    """Into how many parts the keys filed from ``df`` go: four or more to a task, which holds one at a time, and, up to
    ``PARTS``, one for each ``PART`` bytes of the stored tables that ``df`` reads."""
    n = partitions(df.sparkSession)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return n * max(4, min(PARTS, size // PART) // n)


def filed(docs: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """The windows of all texts of ``docs`` (node, text) under their signatures."""
    least = least_words - width + 1

    def own(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(0, batch.num_rows, SLICE):
            node = batch.column("node").slice(k, SLICE).to_numpy()
            texts = [t or "" for t in batch.column("text").slice(k, SLICE).to_pylist()]
            for i, j in text_slices(texts):
                keys, of, packed = signatures(*shingles_of(texts[i:j], width), functions, least)
                yield keys, node[i:j][of], packed

    return docs.select("node", "text").mapInArrow(_filing(own, parts_of(docs)), FILED)


def stored(h: np.ndarray) -> bytes:
    """The first ``KEPT`` bytes of each hash."""
    return np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def read(s: bytes) -> np.ndarray:
    """The numbers that ``stored`` bytes are."""
    out = np.zeros((len(s) // KEPT, 8), dtype=np.uint8)
    out[:, 8 - KEPT :] = np.frombuffer(s, dtype=np.uint8).reshape(-1, KEPT)
    return out.view(">u8").ravel().astype(np.uint64)


def _centred(sequences: DataFrame, rest: DataFrame) -> DataFrame:
    """(node, s, centres) of the texts of ``rest`` (node, centre)."""
    centres = rest.groupBy("node").agg(F.collect_set("centre").alias("centres"))  # at most a text's windows
    return sequences.select("node", "s").join(centres.hint("shuffle_merge"), "node")


def filed_again(sequences: DataFrame, rest: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """The whole passages around the centres of ``rest`` (node, centre), under their hashes."""

    def own(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, node in enumerate(batch.column("node").to_pylist()):
            h = read(batch.column("s")[i].as_py())
            keys, packed = whole_passages(h, np.array(batch.column("centres")[i].as_py(), dtype=np.int64), least_words - width + 1)
            yield keys, np.full(len(keys), node, dtype=np.int64), packed

    return _centred(sequences, rest).mapInArrow(_filing(own, parts_of(sequences)), FILED)


def contexts(sequences: DataFrame, rest: DataFrame) -> DataFrame:
    """(node, centre, around, keys): the shingles on either side of each centre of ``rest`` (node, centre), in
    32 bits, and the min-hashes by which a large group deals them."""
    seeds = np.array([(7 * d + 3) * 0x9FB21C651E98DF25 % (1 << 64) for d in range(DEALINGS)], dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, centre, around, keys = [], [], [], [np.zeros(0, dtype=np.int64)]
        for n, s, at in zip(*(batch.column(c).to_pylist() for c in ("node", "s", "centres")), strict=True):
            h = read(s)
            short = (h >> np.uint64(8 * KEPT - 32)).astype("<u4").tobytes()
            node += [n] * len(at)
            centre += at
            around += [short[4 * max(0, c - AROUND) : 4 * (c + AROUND + 1)] for c in at]
            c = np.array(at, dtype=np.int64)
            ends = np.stack([c - AROUND, c + 1, c - AROUND // 2, c + AROUND // 2 + 1, c, c + AROUND + 1], axis=1).clip(0, len(h)).ravel()
            mixed = np.append(mix(h[None, :] ^ seeds[:, None]), np.zeros((DEALINGS, 1), dtype=np.uint64), axis=1)  # an end may be the text's
            keys.append(np.minimum.reduceat(mixed, ends, axis=1)[:, ::2].T.ravel().view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * 3 * DEALINGS), pa.array(np.concatenate(keys)))
        return pa.record_batch([pa.array(node, pa.int64()), pa.array(centre, pa.int64()), pa.array(around, pa.binary()), lists], names=["node", "centre", "around", "keys"])

    return map_batches(_centred(sequences, rest), run, "node long, centre long, around binary, keys array<long>", 64)


def _spread(hits: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners of places, how many each has, and from the first to the last of them."""
    first = np.flatnonzero(np.diff(of[hits], prepend=-1))
    last = np.append(first[1:], len(hits))[: len(first)] - 1
    return of[hits[first]], last - first + 1, hits[last] - hits[first] + 1


def go_on(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    """Whether ``least`` or more places in a row are equal: what ``matching`` always finds, told sooner."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    if not len(differ):
        return n >= least
    return max(differ[0], n - 1 - differ[-1]) >= least or bool((differ[1:] - differ[:-1] > least).any())


def led(around: list[np.ndarray], need: int, least: int, like: Callable[[np.ndarray, np.ndarray], bool]) -> list[tuple[int, int]]:
    """(leader, member): each text with the first leader that has ``need`` of its elements, spread over
    ``least`` or more of its places, and is ``like`` it; a text without one leads itself. A leader is compared
    with all later texts at once."""
    if len(around) == 2:
        return [(0, 1)] if like(*around) else []
    of = np.repeat(np.arange(len(around)), [len(x) for x in around])
    values, at = np.unique(np.concatenate([np.zeros(0, dtype="<u4"), *around]), return_inverse=True)
    shared = np.bincount(np.unique(of * len(values) + at) % max(1, len(values)), minlength=len(values)) > 1
    j, n, span = _spread(np.flatnonzero(shared[at]), of)
    may = np.zeros(len(around), dtype=bool)
    may[j] = (n >= need) & (span >= least)  # others have no one to meet
    if not may.all():
        kept = np.flatnonzero(may)
        return [(int(kept[a]), int(kept[b])) for a, b in led([around[k] for k in kept], need, least, like)] if len(kept) > 1 else []
    begin = np.searchsorted(of, np.arange(len(around) + 1))
    out, free = [], np.ones(len(around), dtype=bool)
    has = np.zeros(len(values), dtype=bool)
    for k in range(len(around) - 1):
        if free[k]:  # it leads: members before it have their leaders
            own = at[begin[k] : begin[k + 1]]
            has[own] = True
            hits = np.flatnonzero(has[at[begin[k + 1] :]]) + begin[k + 1]
            has[own] = False
            j, n, span = _spread(hits, of)
            near = free[j] & (n >= need) & (span >= least)
            new = [int(m) for m in j[near] if like(around[k], around[m])]
            out += [(k, m) for m in new]
            free[new] = False
    return out


MET = "signature long, a long, b long, shift long, a0 long, a1 long, b0 long, b1 long, slots long, centre_a long, centre long"


def _meeting(least: int, threshold: float):
    like = lambda x, y: go_on(x, y, least) or bool(matching(y, x, least, threshold))
    need = math.ceil(threshold * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each run of ``chunk``; rows come sorted by (chunk, node, centre)."""

        def one(rows: list[tuple]) -> list[tuple]:
            around = [np.frombuffer(x, dtype="<u4") for *_, x in rows]
            found = []
            for i, j in led(around, need, least, like):
                (_, signature, a, ca, _), (_, _, b, cb, _) = rows[i], rows[j]
                if a != b:
                    found.append((signature, a, b, (ca - cb) >> 5, ca - AROUND, ca + AROUND + 1, cb - AROUND, cb + AROUND + 1, 1, ca, cb))
            return found

        held: list[tuple] = []
        out: list[tuple] = []
        names = [x.split()[0] for x in MET.split(", ")]
        whole = lambda: pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "signature", "node", "centre", "around")), strict=True):
                if held and held[-1][0] != row[0]:
                    out += one(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            yield whole()
            out = []
        if len(held) > 1:
            out = one(held)
            yield whole()

    return run


ELEMENTS = "signature long, element long, node long, centre long, first long, last long, n long, known boolean"


def _element_rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in cols], names=[x.split()[0] for x in ELEMENTS.split(", ")])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task knows of its members (signature, node, centre, around): ``known`` the shingles, their first and last
    place and their number, that each has in common with another one here; and each shingle of a signature once, of
    no place and number if it is in a ``known`` row."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        signature, node, centre = (np.array([x[k] for x in held], dtype=np.int64) for k in range(3))
        element, first, last, n = (np.concatenate([x[k] for x in held]).astype(np.int64) for k in range(3, 7))
        of = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
        order = np.lexsort((element, signature[of]))
        element, first, last, n, of = element[order], first[order], last[order], n[order], of[order]
        new = np.append(True, (element[1:] != element[:-1]) | (signature[of[1:]] != signature[of[:-1]]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(new)))
        many = np.repeat(size > 1, size)
        low, high, total = np.full(len(held), _FAR), np.full(len(held), -1), np.zeros(len(held), dtype=np.int64)
        np.minimum.at(low, of[many], first[many])
        np.maximum.at(high, of[many], last[many])
        np.add.at(total, of[many], n[many])
        own, several = np.flatnonzero(total), size > 1
        i = of[start]
        passed = (signature[i], element[start], node[i], centre[i], np.where(several, _FAR, first[start]), np.where(several, -1, last[start]), np.where(several, 0, n[start]), np.zeros(len(start), dtype=bool))
        known = (signature[own], np.zeros(len(own), dtype=np.int64), node[own], centre[own], low[own], high[own], total[own], np.ones(len(own), dtype=bool))
        return _element_rows(*map(np.concatenate, zip(passed, known, strict=True)))

    held, number = [], 0
    for batch in batches:
        for signature, node, centre, around in zip(*(batch.column(c).to_pylist() for c in ("signature", "node", "centre", "around")), strict=True):
            x = np.frombuffer(around, dtype="<u4")
            values, first, n = np.unique(x, return_index=True, return_counts=True)
            held.append((signature, node, centre, values, first, len(x) - 1 - np.unique(x[::-1], return_index=True)[1], n))
            number += len(values)
            if number >= FLUSH:
                yield rows(held)
                held, number = [], 0
    if number:
        yield rows(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of shingles that several rows have; they come sorted by (signature, element)."""
    rest: pa.Table | None = None

    def several(table: pa.Table) -> pa.RecordBatch:
        cols = [c.to_numpy() for c in table.columns]
        start = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))) if len(cols[0]) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(start, len(cols[0])))
        ok = np.repeat(size > 1, size) & (cols[6] > 0)
        return _element_rows(*(c[ok] for c in cols))

    for batch in batches:
        own = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if own.num_rows:
            s, e = own.column("signature").to_numpy(), own.column("element").to_numpy()
            last = int(np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])))[-1])  # it may go on in the next batch
            rest = own.slice(last)
            yield several(own.slice(0, last))
    if rest is not None:
        yield several(rest)


def with_partners(members: DataFrame, least: int, threshold: float) -> DataFrame:
    """The ``members`` (signature, node, centre, around) that may be like another of their signature: those with
    enough shingles, spread over ``least`` or more places, that another one has. No others are like any.

    A task sums up what its own members have in common and passes on each shingle of a signature once, so however
    many members have one, its rows are no more than the tasks, and nothing is joined."""
    key = ["signature", "node", "centre"]
    names = [x.split()[0] for x in ELEMENTS.split(", ")]
    found = cut(members.mapInArrow(_elements, ELEMENTS), "elements")
    once = found.where("NOT known").repartition(partitions(members.sparkSession), "signature", "element").sortWithinPartitions("signature", "element")
    shared = once.mapInArrow(_shared, ELEMENTS).unionByName(found.where("known")).select(names)
    may = shared.groupBy(*key).agg(F.sum("n").alias("n"), (F.max("last") - F.min("first") + 1).alias("span"))
    out = cut(members.join(may.where((F.col("n") >= math.ceil(threshold * least)) & (F.col("span") >= least)).select(*key).hint("shuffle_merge"), key), "left")
    discard(found)
    return out


def met(sequences: DataFrame, rest: DataFrame, least: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of ``rest`` (signature, node, centre, k) that share a passage around the centre: each member with
    its first leader; and the tables that they are read from. ``k`` is about how many members the signature has.

    Min-hashes deal a large signature's members first. Those that find no leader so, the leaders
    among them, are compared with each other after that, all with all: block by block, if they are many."""
    key = ["signature", "node", "centre"]

    def compared(rows: DataFrame) -> DataFrame:
        placed = rows.repartition(partitions(rest.sparkSession), "chunk").sortWithinPartitions("chunk", "node", "centre")
        return placed.mapInArrow(_meeting(least, threshold), MET)

    around = cut(contexts(sequences, rest), "around")

    def surrounded(rows: DataFrame) -> DataFrame:
        return rows.join(around.drop("keys").hint("shuffle_merge"), ["node", "centre"])

    small = rest.where(F.col("k") <= MEET).select(*key, F.xxhash64("signature").alias("chunk"))
    large = rest.where(F.col("k") > MEET)
    if large.isEmpty():
        return compared(surrounded(small)), [around]
    dealt = large.join(around.drop("around").hint("shuffle_merge"), ["node", "centre"]).select(*key, F.posexplode("keys").alias("turn", "part"))
    dealt = cut(dealt, "dealt")
    # a part that is still large is that of texts which agree around the centre; it is dealt on by node
    by = ["signature", "turn", "part"]
    parts = cut(dealt.groupBy(*by).agg(F.count("*").alias("m")).where(F.col("m") > MEET), "parts")
    total = parts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    split = heavy_join(dealt, parts, by, "m", total).withColumn("on", F.pmod(F.xxhash64("node", "turn"), F.ceil(F.col("m") / MEET))).drop("m")
    plain = dealt.join(parts.select(*by), by, "left_anti").withColumn("on", F.lit(0).cast("long"))
    rows = split.unionByName(plain).select(*key, F.xxhash64(*by, "on").alias("chunk"))
    found = cut(compared(surrounded(small.unionByName(rows))), "met")
    # a leader comes before its members in every chunk, so who leads the others of a chain has no leader
    led_ones = found.select("signature", F.col("b").alias("node"), "centre").distinct()
    discard(dealt, parts)
    left = with_partners(surrounded(large.select(*key).join(led_ones.hint("shuffle_merge"), key, "left_anti")), least, threshold)
    sizes = cut(left.groupBy("signature").agg(F.count("*").alias("m")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    number = F.when(F.col("m") <= MEET, 1).otherwise(F.ceil(F.col("m") / (MEET // 2)))
    blocks = heavy_join(left, sizes, ["signature"], "m", total).withColumn("number", number.cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "centre"), "number").cast("int"))
    pairs = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("number") - 1))).where("number = 1 OR with <> block")
    last = compared(pairs.select(*key, "around", F.xxhash64("signature", F.least("block", "with"), F.greatest("block", "with")).alias("chunk")))
    return found.unionByName(last), [around, found, left, sizes]


LINKED = "signature long, a long, b long, shift long, a0 long, a1 long, b0 long, b1 long, slots long, centre_a long, centre long"


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a key with its first; rows come sorted by part."""
    names = [x.split()[0] for x in LINKED.split(", ")]

    def links(near: list[bytes], far: list[bytes]) -> pa.RecordBatch:
        key, node, packed = _columns(near, 3)
        order = _ordered(key.view(np.uint64), node, packed)
        order = order[np.repeat(size > 1, size)] if len((size := _runs(key[order])[1])) else order
        key, node, packed = key[order], node[order], packed[order]
        start, size = _runs(key)
        lead = np.repeat(start, size)
        ok = (node[lead] != node) | (packed[lead] != packed)  # other places of the first are members too
        signature, b, pb, a, pa_ = (np.concatenate(x) for x in zip((key[ok], node[ok], packed[ok], node[lead[ok]], packed[lead[ok]]), _columns(far, 5), strict=True))
        c = lambda x: x >> (2 * _SIDE + 4)
        before = np.minimum(pa_ >> (_SIDE + 4) & _SIDES, pb >> (_SIDE + 4) & _SIDES)
        after = np.minimum(pa_ >> 4 & _SIDES, pb >> 4 & _SIDES)
        before, after = (np.where(x == _SIDES, _FAR, x) for x in (before, after))  # it reaches on: to the end
        cols = (signature, a, b, (c(pa_) - c(pb)) >> 5, c(pa_) - before, c(pa_) + after + 1, c(pb) - before, c(pb) + after + 1, 1 << (pb & 15), c(pa_), c(pb))
        return pa.record_batch([pa.array(x) for x in cols], names=names)

    part, held = None, []
    for batch in batches:
        for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "near", "far")), strict=True):
            if p != part and held:
                yield links(*zip(*held, strict=True))
                held = []
            part = p
            held.append(row)
    if held:
        yield links(*zip(*held, strict=True))


def matching(x: np.ndarray, y: np.ndarray, least: int, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """(x0, x1, y0, y1, similarity) of the maximal stretches of ``least`` or more shingles of ``x``
    whose set is similar to that of a stretch of ``y``."""
    if min(len(x), len(y)) == 0:
        return []
    order = np.argsort(y, kind="stable")
    sorted_y = y[order]
    place = np.minimum(np.searchsorted(sorted_y, x), len(y) - 1)  # of the first that is equal
    hit = sorted_y[place] == x
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin) or end[-1] - begin[0] < least:
        return []
    start, size = _runs(sorted_y)
    if len(start) == len(x) == len(y) >= least and (x == y).all():
        return [(0, len(x), 0, len(y), 1.0)]
    number = np.zeros(len(y), dtype=np.int64)
    number[start] = size
    of_y = np.empty(len(y), dtype=np.int64)
    of_y[order] = np.repeat(start, size)

    def verified(a: int, b: int) -> tuple[int, int, int, int, float] | None:
        """The stretch with its counterpart in ``y``: around the shift that most shingles agree on."""
        low, found = place[a:b], hit[a:b]
        own = np.flatnonzero(found & (number[low] == 1))
        own = own if len(own) else np.flatnonzero(found)
        at = order[low[own]] - own
        near = np.abs(at - np.median(at)) <= 64
        places = order[low[own[near]]] if near.any() else order[low[own[:1]]]
        y0, y1 = int(places.min()), int(places.max()) + 1
        if y1 - y0 < least:  # a text that repeats itself: as many shingles from there on
            y1 = min(len(y), y0 + b - a)
        has_x, has_y = np.zeros(len(y), dtype=bool), np.zeros(len(y), dtype=bool)
        has_x[low[found]] = has_y[of_y[y0:y1]] = True
        both = np.count_nonzero(has_x & has_y)
        similar = both / (np.count_nonzero(has_x) + len(set(x[a:b][~found].tolist())) + np.count_nonzero(has_y) - both)
        return (a, b, y0, y1, similar) if similar >= threshold else None

    runs = list(zip(begin.tolist(), end.tolist(), strict=True))
    share = 2 * threshold / (1 + threshold)  # of a stretch that is like another of its length
    out, k = [], 0
    while k < len(runs):
        a, b = runs[k]
        hits, best, j = b - a, k, k + 1
        while j < len(runs) and runs[j][0] - runs[j - 1][1] <= 0.25 * (runs[j][1] - a):
            hits += runs[j][1] - runs[j][0]
            if hits >= share * (runs[j][1] - a):
                best = j
            j += 1
        found = verified(a, runs[best][1]) if runs[best][1] - a >= least else None
        if found is None and best > k and b - a >= least:
            found, best = verified(a, b), k  # the first run alone
        if found is None and b - a >= least and (equal := equal_passage(x[a:b], y, least)):  # texts that repeat themselves
            found, best = (a + equal[0], a + equal[1], *equal[2:], 1.0), k
        if found is not None:
            out.append(found)
            k = best + 1
        else:
            k += 1
    return out


SCHEMA = "doc_id long, first_word int, last_word int, other_doc_id long, other_first_word int, other_last_word int, similarity double"


def linked(files: DataFrame) -> DataFrame:
    """Each member of a key with its first, intervals aligned at the common shingle."""
    return files.repartition(partitions(files.sparkSession), "part").sortWithinPartitions("part").mapInArrow(_linked, LINKED)


def keyed_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, text) of each row, and (node, doc_id) of the rows whose node is not their id: ids that are
    missing or occur again give way to a number made from the row's place, above all other nodes."""
    _, rows = with_rows(docs, "doc_id", "text")
    twice = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1")
    made = F.xxhash64(*ROW).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    other = F.col("doc_id").isNull() | F.col("__n").isNotNull()
    marked = rows.join(twice, F.col("doc_id") == F.col("__id"), "left") if not twice.isEmpty() else rows.withColumn("__n", F.lit(None).cast("long"))
    named = marked.withColumn("node", F.when(other, made).otherwise(F.col("doc_id")))
    return named.select("node", "text"), named.where(other).select("node", "doc_id")


def sequences_of(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, s): the shingles of the texts of ``nodes``, in order."""

    def sequence(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = [t or "" for t in batch.column("text").to_pylist()], []
        for i, j in text_slices(texts):
            h, begin = shingles_of(texts[i:j], width)
            s, ends = stored(h), (begin * KEPT).tolist()
            out += [s[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return pa.record_batch([batch.column("node"), pa.array(out, pa.binary())], names=["node", "s"])

    return map_batches(texts.join(nodes.hint("shuffle_merge"), "node", "left_semi"), sequence, "node long, s binary")  # one plan at every size


def repeated(docs: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS, functions: int = FUNCTIONS, enough: int = ENOUGH, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each passage of ``doc_id`` that repeats or nearly repeats one of ``other_doc_id``,
    a lesser id filed under its signatures. Words are counted from 0; last ones are inclusive."""
    least = least_words - width + 1
    texts, other = keyed_texts(docs)
    pairs = cut(linked(filed(texts, width, least_words, functions)), "members")
    links = linked_intervals(pairs.where("a <> b"), least, enough, threshold)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    sequences = cut(sequences_of(texts, nodes, width), "sequences")
    found = cut(verified(sequences, links, width, least, threshold), "found")
    known = found.select(F.col("other_doc_id").alias("x"), F.col("doc_id").alias("y"), "first_word", (F.col("last_word") - width + 1).alias("last_shingle"))
    same = (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & F.col("centre").between(F.col("first_word"), F.col("last_shingle"))
    # a centre's members are all filed under its shingle alone, so only such signatures matter here; a member whose
    # passage goes on as the least id's does, as far as any passage with the centre reaches, has no other to find
    alone = pairs.where(F.expr(f"(slots & {ALONE}) <> 0"))
    spans = known.groupBy("x", "y").agg(F.collect_list(F.struct("first_word", "last_shingle")).alias("spans"))  # at most a text's passages
    c = F.col("centre")
    holds = lambda before, after: F.coalesce(F.exists("spans", lambda s: (s["first_word"] <= F.greatest(c - before, F.lit(0))) & (s["last_shingle"] >= c + after)), F.lit(False))
    met_already = alone.where("a <> b").join(spans.hint("shuffle_merge"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    marked = cut(met_already.select("signature", "a", "centre_a", "b", "centre", holds(0, 0).alias("verified"), holds(least - 1, least - 1).alias("covered")), "marked")
    several = marked.groupBy("signature").agg(F.count_if(~F.col("verified")).alias("bad"), F.count_if(~F.col("covered")).alias("k")).where("bad > 0 AND k > 1")
    several = cut(several.select("signature", "k"), "several")
    total = several.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    sides = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("centre_a").alias("centre")), F.struct(F.col("b").alias("node"), "centre"))).alias("m")
    members = marked.where("NOT covered").select("signature", sides).select("signature", "m.*")
    members = members.unionByName(alone.where("a = b").select("signature", F.col("b").alias("node"), "centre")).distinct()
    rest = cut(heavy_join(members, several, ["signature"], "k", total), "rest")
    discard(pairs, marked, several, links)
    again = linked(filed_again(sequences, rest.select("node", "centre").distinct(), width, least_words)).where("a <> b")
    within = (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("b0") >= F.col("first_word")) & (F.col("b1") - 1 <= F.col("last_shingle"))
    again = again.join(known.hint("shuffle_merge"), within, "left_anti")
    meeting, tables = met(sequences, rest, least, threshold)
    again = cut(again.unionByName(meeting.join(known.hint("shuffle_merge"), same, "left_anti")), "members")
    more_links = linked_intervals(again, least, 1, threshold)
    more = cut(verified(sequences, more_links, width, least, threshold), "found")
    discard(sequences, rest, again, more_links, *tables)
    out = found.unionByName(more).distinct()
    if other.isEmpty():
        return out
    for name in ("doc_id", "other_doc_id"):
        ids = other.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"))
        out = out.join(ids, F.col(name) == F.col("__node"), "left").withColumn(name, F.when(F.col("__node").isNull(), F.col(name)).otherwise(F.col("__id"))).drop("__node", "__id")
    return out


def linked_intervals(pairs: DataFrame, least: int, enough: int, threshold: float) -> DataFrame:
    """(a, b, a0, a1, b0, b1): the aligned intervals of each pair that agrees under ``enough`` signatures,
    joined where they lie at about the same distance, and widened by a passage."""
    links = pairs.groupBy("a", "b", "shift").agg(F.min("a0").cast("int").alias("a0"), F.max("a1").cast("int").alias("a1"), F.min("b0").cast("int").alias("b0"), F.max("b1").cast("int").alias("b1"), F.bit_or("slots").alias("slots"))
    # near copies have as many shingles in common; words put in or left out move an interval's far ends
    links = links.where((F.bit_count("slots") >= enough) & (F.col("a1") - F.col("a0") >= math.ceil(threshold * least)))
    return cut(links.select("a", "b", *[c for x in "ab" for c in (F.greatest(F.col(f"{x}0") - least, F.lit(0)).alias(f"{x}0"), (F.col(f"{x}1") + least).alias(f"{x}1"))]), "links")


def verified(sequences: DataFrame, links: DataFrame, width: int, least: int, threshold: float) -> DataFrame:
    """The rows of ``repeated`` that are found within the intervals of ``links``."""
    part = lambda s, x: F.substring(s, F.col(f"{x}0") * KEPT + 1, (F.col(f"{x}1") - F.col(f"{x}0")) * KEPT)
    left, right = (sequences.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    both = links.join(left, "a").withColumn("s_a", part(F.col("s_a"), "a")).join(right, "b").select("a", "b", "a0", "b0", "s_a", part(F.col("s_b"), "b").alias("s_b"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for a, b, a0, b0, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a0", "b0", "s_a", "s_b")), strict=True):
            for y0, y1, x0, x1, s in matching(read(y), read(x), least, threshold):
                rows.append((b, b0 + y0, b0 + y1 + width - 2, a, a0 + x0, a0 + x1 + width - 2, s))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(both, verify, SCHEMA).distinct()
