"""N-gram Jaccard join: Bayesian candidate pruning.

Each text is the set of its five-word shingles. Texts with equal sets form one class and are
compared once. MinHash bands propose pairs of classes; the signatures of a pair are compared a few
values at a time, and the pair is dropped as soon as the posterior probability (uniform prior)
that its similarity reaches the threshold falls below a tolerance; the rest are verified exactly
on their shingle sets. Verified links are joined to connected components.

A bucket of up to ``FULL`` classes proposes all its pairs. The members of a larger one are filed again
under finer buckets, each of that band together with one of the ``FINER`` bands after it, so texts that
merely have a form in common part (two texts of similarity s agree on both with s ** 8). A pair of similar
texts either shares a bucket that is small, or many large ones of which two lie within that reach. Whether
a bucket is large depends on the number of its members alone, not on how rows lie in partitions.
Finer buckets that are still large make hot groups (components over what connects their members, which
each task reduces to as few edges as it takes), and each group is compared with itself in blocks. Its members are dealt by hash to blocks of bounded number and
bytes, every two blocks meet in a task of their own, and what comes out is not the links but each member's
number of them and a tree of each set of connected members, so that a group of m members gives m / BLOCK
rows of each and no task holds more than two blocks. The work in such a group is that of all its pairs;
none is capped. A task that holds more than ``FULL`` members of a bucket itself passes on one of them,
so that a bucket of any size reaches the shuffle as a few rows of each task.

All links found are verified exactly. The risk to miss one is that of the bands (under 1e-7 for a pair
at the threshold; under 2e-5 if every bucket that it shares is large) plus the tolerance.

Each row of the table is told apart by its place in the stored files, and a class is the rows of one
shingle set (by 128 bits of hash), so neither repeated nor missing ids mix up texts.

Defined results: null and empty texts have the empty set and form one class; a text of fewer than
five words is one shingle of its words; repeated rows each get a row; rows of one id with different texts
are told apart; a class without any id, or whose least id leads another class too, has a negative number
made from its shingles as ``class_id``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pagemill.llm.common import ROW, cut, discard, heavy_join, least_members, map_batches, mix, partitions, shingle_hashes, tree_parents, with_rows
from pagemill.llm.components import components

#: Similarity, words of a shingle, signature values, bands, tolerance, values compared at a time.
THRESHOLD, WIDTH, VALUES, BANDS, TOLERANCE, STEP = 0.8, 5, 128, 32, 1e-6, 16
#: A bucket of so many members or fewer proposes all its pairs; bands after a band that make finer ones.
FULL, FINER = 24, 10
#: Members and bytes of shingles of a block of a hot group; shingles that are multiplied at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 16 << 20, 2048
#: Edges of hot groups that a task reduces to what connects their nodes.
EDGES = 1 << 22
#: Pairs whose signatures are compared at a time.
PAIRS = 4096
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", width))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set of shingles; zeros for the empty set."""
    if not len(s):
        return 0, 0
    n = np.uint64(len(s) * 0x9E3779B97F4A7C15 % (1 << 64))
    one, two = mix(s).sum(dtype=np.uint64) ^ n, mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) ^ n
    return int(one.view(np.int64)), int(two.view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(s), 2048):
        h = (s[k : k + 2048, None] * _A + _B) >> np.uint64(32)
        np.minimum(out, h.min(axis=0).astype(np.uint32), out=out)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def least_matches(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> dict[int, int]:
    """After n compared values, the fewest matches m with P(similarity >= threshold | m of n) at
    least ``tolerance``, from Beta(m + 1, n - m + 1)."""
    t = (np.arange(20000) + 0.5) / 20000
    out = {}
    for n in range(step, values + 1, step):
        for m in range(n + 1):
            logs = m * np.log(t) + (n - m) * np.log1p(-t)
            p = np.exp(logs - logs.max())
            if p[t >= threshold].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of two (pairs, values) signature arrays are not dropped on the way."""
    left, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    before = 0
    for n, m in least.items():
        matches += (a[left, before:n] == b[left, before:n]).sum(axis=1)
        keep = matches >= m
        left, matches, before = left[keep], matches[keep], n
    out = np.zeros(len(a), dtype=bool)
    out[left] = True
    return out


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return start, np.diff(np.append(start, len(key)))


def _pairs(node: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of each run of at most ``FULL``."""
    a, b = [node[:0]], [node[:0]]
    for n in range(2, FULL + 1):
        at = start[size == n]
        if len(at):
            i, j = np.triu_indices(n, 1)
            a.append(node[(at[:, None] + i).ravel()])
            b.append(node[(at[:, None] + j).ravel()])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


BUCKETS = "key long, a long, b long, over boolean, done boolean"


def _filed(key: np.ndarray, node: np.ndarray, band: int | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns of ``BUCKETS`` rows that a task passes on: members ``a`` of buckets (``over`` if the task
    holds more of it than ``FULL`` and passes on the first) and, under keys of their own and with a band,
    ``done`` the members of such buckets as (node, band). Without a band, the edges of trees over them."""
    order = np.lexsort((node, key))
    k, n = key[order].view(np.int64), node[order]
    start, size = _groups(k)
    place = np.arange(len(n)) - np.repeat(start, size)
    over = np.repeat(size > FULL, size)
    go = ~over | (place == 0)
    none = np.zeros(0, dtype=np.int64)
    if band is None:
        far = over & (place > 0)
        return [k[go], n[go], n[go], over[go], np.zeros(np.count_nonzero(go), dtype=bool)], n[tree_parents(start, size)][far], n[far]
    own, same = mix(k[over].view(np.uint64) ^ mix(n[over].view(np.uint64))).view(np.int64), np.full(len(n), band, dtype=np.int64)
    flags = np.repeat([False, True], [np.count_nonzero(go), np.count_nonzero(over)])
    return [*(np.concatenate(x) for x in ((k[go], own), (n[go], n[over]), (same[go], same[over]), (over[go], over[over]))), flags], none, none


def _batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in cols], names=[x.split()[0] for x in BUCKETS.split(", ")])


def _band_hashes(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of each band of the signatures."""
    rows = VALUES // BANDS
    out = np.empty((len(sig), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sig), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = mix(key ^ sig[:, k]) + np.uint64(band)
        out[:, band] = key
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(nodes, band hashes, whether each band's bucket is large) of a task's rows."""
    nodes, hashes, large = [], [], []
    for batch in batches:
        nodes.append(batch.column("node").to_numpy())
        hashes.append(_band_hashes(np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, VALUES)))
        if "bands" in batch.schema.names:
            bits = batch.column("bands").to_numpy()
            large.append((bits[:, None] >> np.arange(BANDS)) & 1 > 0)
    return (np.concatenate(nodes), np.concatenate(hashes), np.concatenate(large) if large else np.zeros(0)) if nodes else None


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if (got := _read(batches)) is not None:
        node, key, _ = got
        for band in range(BANDS):
            yield _batch(_filed(key[:, band], node, band)[0])


def _finer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if (got := _read(batches)) is not None:
        node, key, large = got
        x = y = np.zeros(0, dtype=np.int64)
        for band in range(BANDS):
            own, edges = large[:, band], [(x, y)]
            for k in range(1, FINER + 1):
                if own.any():
                    cols, a, b = _filed(mix(key[own, band] ^ mix(key[own, (band + k) % BANDS] + np.uint64(k))), node[own], None)
                    edges.append((a, b))
                    yield _batch(cols)
            x, y = least_members(*map(np.concatenate, zip(*edges, strict=True)))
        yes = np.ones(len(x), dtype=bool)
        yield _batch([mix(y.view(np.uint64)).view(np.int64), x, y, yes, yes])


def _bucket_pairs(banded: bool):
    """(a, b, hot): the pairs of small buckets, and hot what large ones give: members with their band, or
    edges that connect them, each task's as few as it takes. Rows come sorted by (done, key, a)."""

    def proposed(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        node = own.a.to_numpy()
        start, size = _groups(own.key.to_numpy())
        hot = size > FULL
        if len(start):
            hot |= np.logical_or.reduceat(own.over.to_numpy(dtype=bool), start)
        within = np.repeat(hot, size)
        other = own.b.to_numpy() if banded else node[tree_parents(start, size)]
        return *_pairs(node, start[~hot], size[~hot]), node[within], other[within]

    def rows(a: np.ndarray, b: np.ndarray, hot: bool) -> pd.DataFrame:
        return pd.DataFrame({"a": a, "b": b, "hot": np.full(len(a), hot)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, x = None, np.zeros(0, dtype=np.int64)
        y = x

        def taken(own: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal x, y
            a, b, c, d = proposed(own)
            yield rows(a, b, False)
            if banded:
                yield rows(c, d, True)
            else:
                x, y = least_members(np.concatenate([x, d]), np.concatenate([y, c]))

        for batch in batches:
            done = batch[batch.done]
            if len(done):
                yield rows(done.a.to_numpy(), done.b.to_numpy(), True)
            own = batch[~batch.done]
            if rest is not None:
                own = pd.concat([rest, own])
            last = int(np.searchsorted(own.key.to_numpy(), own.key.iloc[-1])) if len(own) else 0  # it may go on in the next batch
            rest = own.iloc[last:]
            yield from taken(own.iloc[:last])
        if rest is not None:
            yield from taken(rest)
        yield rows(x, y, True)

    return run


def common_shingles(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The numbers of common shingles of each of ``x`` with each of ``y``, by products of slices
    of the incidence matrices; only shingles of both sides have a column."""
    flat = [np.concatenate([np.zeros(0, dtype=np.uint64), *sets]) for sets in (x, y)]
    row = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (x, y)]
    columns = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)))
    cells = []
    for f, r in zip(flat, row, strict=True):
        at = np.searchsorted(columns, f)
        ok = at < len(columns)
        ok[ok] = columns[at[ok]] == f[ok]
        by = np.argsort(at[ok], kind="stable")
        cells.append((at[ok][by], r[ok][by]))
    for low in range(0, len(columns), COLUMNS):
        dense = []
        for (at, r), sets in zip(cells, (x, y), strict=True):
            i, j = np.searchsorted(at, (low, low + COLUMNS))
            m = np.zeros((len(sets), min(COLUMNS, len(columns) - low)), dtype=np.float32)
            m[r[i:j], at[i:j] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def linked(sig_x: np.ndarray, x: list[np.ndarray], sig_y: np.ndarray, y: list[np.ndarray], least: dict[int, int], threshold: float) -> np.ndarray:
    """Which of ``x`` are similar to which of ``y``: pruned by signatures, the rest verified exactly."""
    n, fewest = next(iter(least.items()))
    matches = np.zeros((len(x), len(y)), dtype=np.int16)
    for k in range(n):
        matches += sig_x[:, k, None] == sig_y[None, :, k]
    i, j = np.nonzero(matches >= fewest)
    out = np.zeros(matches.shape, dtype=bool)
    for at in range(0, len(i), 1 << 14):
        p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        out[p, q] = surviving(sig_x[p], sig_y[q], least)
    if out.any():
        some_x, some_y = np.flatnonzero(out.any(axis=1)), np.flatnonzero(out.any(axis=0))
        both = common_shingles([x[k] for k in some_x], [y[k] for k in some_y])
        union = np.array([len(x[k]) for k in some_x])[:, None] + np.array([len(y[k]) for k in some_y]) - both
        out[np.ix_(some_x, some_y)] &= both / np.maximum(union, 1) >= threshold
    return out


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a tree of bounded degree over each connected set of a symmetric adjacency matrix."""
    left, a, b = np.ones(len(near), dtype=bool), [], []
    for s in range(len(near)):
        if not left[s]:
            continue
        left[s], open_, own = False, [s], [s]
        while open_:
            new = np.flatnonzero(near[open_.pop()] & left)
            left[new] = False
            open_ += new.tolist()
            own += new.tolist()
        if len(own) > 1:
            c = np.sort(own)
            up = tree_parents(np.zeros(1, dtype=np.int64), np.array([len(c)]))
            a.append(c[up[1:]])
            b.append(c[1:])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _two_blocks(least: dict[int, int], threshold: float):
    def run(members: pa.Table) -> pa.Table:
        """(node, null, number of links) and (a, b, null) of a spanning forest, from two blocks."""
        node, block = members.column("node").to_numpy(), members.column("block").to_numpy()
        order = np.lexsort((node, block))
        node, block = node[order], block[order]
        sigs, sets = members.column("sig").to_pylist(), members.column("s").to_pylist()
        sig = np.frombuffer(b"".join(sigs[k] for k in order), dtype=np.uint32).reshape(-1, VALUES)
        s = [np.frombuffer(sets[k], dtype=np.uint64) for k in order]
        i, j = members.column("i")[0].as_py(), members.column("j")[0].as_py()
        near = np.zeros((len(node), len(node)), dtype=bool)
        if i == j:
            near = linked(sig, s, sig, s, least, threshold)
            np.fill_diagonal(near, False)
        else:
            n = int(np.count_nonzero(block == i))
            near[:n, n:] = linked(sig[:n], s[:n], sig[n:], s[n:], least, threshold)
            near[n:, :n] = near[:n, n:].T
        number, (x, y) = near.sum(axis=1), _forest(near)
        some = np.flatnonzero(number)
        a, b = np.concatenate([node[some], node[x]]), np.concatenate([node[some], node[y]])
        count = np.concatenate([number[some], np.zeros(len(x), dtype=np.int64)])
        return pa.table({"a": pa.array(np.where(a < b, a, b)), "b": pa.array(np.where(a < b, b, a)), "n": pa.array(count, pa.int64())})

    return run


def signatures(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row key, doc_id, h1, h2, sig) of each row: the hashes of its shingle set, and its MinHash values."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
        one, two = zip(*map(set_hash, sets), strict=True)
        kept = [batch.column(c) for c in (*ROW, "doc_id")]
        return pa.record_batch([*kept, pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=[*ROW, "doc_id", "h1", "h2", "sig"])

    return map_batches(keyed.select(*ROW, "doc_id", "text"), run, f"{ROW[0]} long, {ROW[1]} long, doc_id long, h1 long, h2 long, sig binary")


def proposals(classes: DataFrame) -> DataFrame:
    """(a, b, hot) over ``classes`` (node, sig): the pairs that bands propose, and the edges of hot groups."""
    n = partitions(classes.sparkSession)

    def reduced(rows: DataFrame, banded: bool) -> DataFrame:
        return rows.repartition(n, "key").sortWithinPartitions("done", "key", "a").mapInPandas(_bucket_pairs(banded), "a long, b long, hot boolean")

    first = cut(reduced(classes.select("node", "sig").mapInArrow(_band_rows, BUCKETS), True), "buckets")
    large = first.where("hot").groupBy(F.col("a").alias("node")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b AS INT))")).alias("bands"))
    finer = large.hint("shuffle_merge").join(classes.select("node", "sig"), "node").select("node", "sig", "bands")
    second = reduced(finer.mapInArrow(_finer_rows, BUCKETS), False)
    out = cut(first.where("not hot").unionByName(second).distinct(), "pairs")
    discard(first)
    return out


def fewer_edges(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """Edges (a, b) that connect what ``edges`` do, reduced in tasks of about ``most``, by their first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = y = np.zeros(0, dtype=np.int64)
        for batch in batches:
            x, y = least_members(np.concatenate([x, batch.column("a").to_numpy()]), np.concatenate([y, batch.column("b").to_numpy()]))
        yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

    n = edges.count()
    return edges.repartition(-(-n // most) if n else 1, "a").mapInArrow(run, "a long, b long")


def similar_pairs(keyed: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Of ``classes`` (node, sig, and the key of a row that has it): verified links (a, b) that connect all
    that are similar, and (node, n_links), the number of all links of each that has any."""
    proposed = proposals(classes)
    hot = components(fewer_edges(proposed.where("hot").select("a", "b")))
    group = lambda x: hot.select(F.col("node").alias(x), F.col("label").alias(f"group_{x}"))
    pairs = proposed.where("not hot").select("a", "b").join(group("a"), "a", "left").join(group("b"), "b", "left")
    pairs = pairs.where(F.coalesce(F.col("group_a") != F.col("group_b"), F.lit(True))).select("a", "b")  # others meet in blocks
    left, right = (classes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    least = least_matches(threshold, tolerance)

    def prune(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, VALUES) for c in ("sig_a", "sig_b")]
        keep = pa.array(surviving(*both, least))
        return pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    kept = cut(map_batches(pairs.join(left, "a").join(right, "b"), prune, "a long, b long", PAIRS), "kept")
    wanted = kept.select(F.col("a").alias("node")).union(kept.select("b")).union(hot.select("node")).distinct()
    wanted = wanted.join(classes.select("node", *ROW), "node")
    texts = keyed.select(*ROW, "text").join(wanted.hint("shuffle_merge"), list(ROW)).select("node", "text")  # one plan at every size

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("node"), pa.array([shingle_set(t, width).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["node", "s"])

    sets = cut(map_batches(texts, shingled, "node long, s binary"), "sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        u64 = lambda c: (np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist())
        return pa.record_batch([batch.column("a"), batch.column("b"), pa.array([jaccard(x, y) for x, y in zip(u64("s_a"), u64("s_b"), strict=True)], pa.float64())], names=["a", "b", "similarity"])

    found = cut(map_batches(kept.join(left, "a").join(right, "b"), verify, "a long, b long, similarity double").where(F.col("similarity") >= threshold).select("a", "b"), "links")
    inside = cut(blocks(hot, classes, sets).groupBy("label", "i", "j").applyInArrow(_two_blocks(least, threshold), "a long, b long, n long"), "inside")
    discard(proposed, kept, sets, hot)
    ends = found.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n")).union(inside.where("n > 0").select("a", "n"))
    return found.union(inside.where("n = 0").select("a", "b")), ends.groupBy("node").agg(F.sum("n").alias("n_links"))


def blocks(hot: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(label, i, j, block, node, sig, s): the members of hot groups (node, label), each once for
    every block of its group, so that blocks i <= j of a group come together."""
    sizes = hot.join(sets, "node").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("s")).alias("bytes"))
    number = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = cut(sizes.select("label", "n", number.alias("number")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = heavy_join(hot, sizes, ["label"], "n", total).withColumn("block", F.pmod(F.xxhash64("node"), F.col("number")).cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("number") - 1))).select("label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node")
    return dealt.join(classes.select("node", "sig"), "node").join(sets, "node")


def _labelled(docs: DataFrame, threshold: float, tolerance: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame, Row]:
    """The stored docs; (row key, doc_id, h1, h2) of each row; (h1, h2, copy_of, n_copies, label, n_links) of each
    class; and the numbers of classes and rows. The classes are a written table: they are read in several places of
    a plan, and a driver that plans all that leads to them in each holds hundreds of exchanges and broadcasts."""
    stored, keyed = with_rows(docs, "doc_id", "text")
    rows = cut(signatures(keyed, width), "signatures")
    one = F.min(F.struct(*ROW)).alias("row")
    merged = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_of"), one, F.min("sig").alias("sig"), F.count("*").alias("n_copies"))
    classes = cut(merged.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "copy_of", "row.*", "sig", "n_copies"), "classes")
    total = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n_copies"), F.lit(0)).alias("rows")).first()
    links, ends = similar_pairs(keyed, classes.where("h1 <> 0 OR h2 <> 0"), threshold, tolerance, width)
    labels = components(links)
    found = labels.join(ends, "node")
    known = classes.select("node", "h1", "h2", "copy_of", "n_copies").join(found, "node", "left").withColumns({"label": F.coalesce("label", "node"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")})
    known = cut(known.drop("node"), "known")
    discard(classes, labels)
    return stored, rows.select(*ROW, "doc_id", "h1", "h2"), known, total


def _named(known: DataFrame, classes: int) -> DataFrame:
    """``known`` with the ``class_id`` of each class's label."""
    groups = cut(known.groupBy("label").agg(F.min("copy_of").alias("lead"), F.min("h1").alias("h"), F.count("*").alias("n")), "groups")
    shared = groups.where("lead IS NOT NULL").groupBy(F.col("lead").alias("id")).agg(F.count("*").alias("k")).where("k > 1")
    made = F.lit(-(1 << 62)) - F.col("h").bitwiseAND(F.lit((1 << 62) - 1))
    names = groups.join(shared, F.col("lead") == F.col("id"), "left").select("label", F.when(F.col("lead").isNull() | F.col("id").isNotNull(), made).otherwise(F.col("lead")).alias("class_id"), "n")
    names = cut(names, "names")
    out = cut(heavy_join(known, names, ["label"], "n", classes).drop("n"), "named")
    discard(known, groups, names)
    return out


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id, copy_of, n_copies, n_links) of each row.

    ``class_id`` is the least id of the texts it is linked to, directly or over others;
    ``copy_of`` is the least id with the same shingles, of which there are ``n_copies``, and
    ``n_links`` the number of verified links from those to other shingle sets, all of them.
    """
    _, rows, known, total = _labelled(docs, threshold, tolerance, width)
    found = heavy_join(rows, _named(known, total.classes), ["h1", "h2"], "n_copies", total.rows)
    return found.select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with one row of each class of similar texts: that of the least id, of
    several the first stored. Rows without an id come after all others."""
    stored, rows, known, total = _labelled(docs, threshold, TOLERANCE, WIDTH)
    found = cut(heavy_join(rows, known.select("h1", "h2", "n_copies", "label"), ["h1", "h2"], "n_copies", total.rows).select(*ROW, "doc_id", "label"), "labelled")
    discard(known)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)
    several = found.groupBy("label").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    several = cut(several, "several")
    gone = heavy_join(found, several, ["label"], "n", total.rows).where(~((F.col("first")[ROW[0]] == F.col(ROW[0])) & (F.col("first")[ROW[1]] == F.col(ROW[1])))).select(*ROW)
    _, keyed = with_rows(stored)
    return keyed.join(gone.hint("shuffle_merge"), list(ROW), "left_anti").select(*docs.columns)
