"""Toxicity: a factorization machine over hashed terms.

A term is a maximal run of letters and digits of the lower-cased text, or the beginning of a longer one
(``PREFIXES`` characters: stems that endings hide), hashed into buckets; a text is the set of its buckets. The machine adds a bias, a weight for each bucket and, for each pair
of buckets, the dot product of their factors, so that two terms can be toxic together where
neither is alone.

Training reads a bounded sample of labelled rows (at most about ``per_class`` of either label,
chosen by a hash of the id; the bias is corrected for the two rates; of several labels of one id the
greatest counts). Buckets enter the model if
they tell the labels apart, over all sampled rows or among the rows that have a bucket which
does. Scoring reads every text, whole.

Defined results: a null label is not learned; null and empty texts have no term and get the score
of the bias; without rows of both labels every score is the share of label 1 (0.0 without rows).
Repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, unit_hash, word_and_prefix_hashes

#: Buckets (a power of two), factors of each, sampled rows of each label, the least chi-square of
#: a bucket, rounds of training, and the score from which a text is called toxic.
BUCKETS, FACTORS, PER_CLASS, LEAST_CHI, ROUNDS, THRESHOLD = 1 << 20, 4, 8000, 15.0, 300, 0.7


PREFIXES = (5, 6, 7)


def terms(text: str | None) -> np.ndarray:
    """The distinct buckets of a text."""
    return np.unique(word_and_prefix_hashes(text or "", PREFIXES) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _chi(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    a, b = with_1.astype(np.float64), with_0.astype(np.float64)
    c, d = n1 - a, n0 - b
    return (n1 + n0) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * n0, 1)


@dataclass
class Machine:
    slot: np.ndarray  # bucket to row of the parameters, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        return float(self.bias + self.weights[rows].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())

    def score(self, text: str | None) -> float:
        rows = self.slot[terms(text)]
        return float(1 / (1 + np.exp(-np.clip(self.raw(rows[rows >= 0]), -40, 40))))


def fit(texts: list[np.ndarray], labels: np.ndarray, offset: float = 0.0, least_chi: float = LEAST_CHI, rounds: int = ROUNDS, seed: int = 7) -> Machine:
    """Full-batch Adam on the log loss. ``offset`` is added to the bias after training."""
    y = labels.astype(np.float64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    empty = np.full(BUCKETS, -1, dtype=np.int32)
    if not n1 or not n0:
        share = np.clip(n1 / max(1, len(y)), 1e-9, 1 - 1e-9)
        return Machine(empty, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    bucket = np.concatenate(texts) if len(texts) else np.zeros(0, dtype=np.int64)

    def chosen(within: np.ndarray) -> np.ndarray:
        keep = within[row]
        one = np.bincount(bucket[keep], weights=y[row[keep]], minlength=BUCKETS)
        all_ = np.bincount(bucket[keep], minlength=BUCKETS)
        m1, m = y[within].sum(), within.sum()
        return (all_ >= 3) & (_chi(one, all_ - one, int(m1), int(m - m1)) >= least_chi)

    found = chosen(np.ones(len(y), dtype=bool))
    having = np.zeros(len(y), dtype=bool)
    having[row[found[bucket]]] = True
    if having.any() and 0 < y[having].mean() < 1:
        found |= chosen(having)
    ids = np.flatnonzero(found)
    slot = empty
    slot[ids] = np.arange(len(ids))
    keep = slot[bucket] >= 0
    r, c = row[keep], slot[bucket[keep]]
    rng = np.random.default_rng(seed)
    p = {"b": np.array([np.log(n1 / n0)]), "w": np.zeros(len(ids)), "v": rng.normal(0, 0.01, (len(ids), FACTORS))}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    gather = lambda values, index, n: np.stack([np.bincount(index, weights=values[:, f], minlength=n) for f in range(values.shape[1])], axis=1)
    for t in range(1, rounds + 1):
        vc = p["v"][c]
        sums = gather(vc, r, len(y))
        z = p["b"][0] + np.bincount(r, weights=p["w"][c], minlength=len(y)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(r, weights=(vc**2).sum(axis=1), minlength=len(y)))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = {
            "b": np.array([e.sum()]),
            "w": np.bincount(c, weights=e[r], minlength=len(ids)) + 1e-6 * p["w"],
            "v": gather(e[r][:, None] * (sums[r] - vc), c, len(ids)) + 1e-5 * p["v"],
        }
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-9)
    return Machine(slot, float(p["b"][0]) + offset, p["w"], p["v"])


def train(docs: DataFrame, labels: DataFrame, rows: Column, per_class: int = PER_CLASS) -> Machine:
    """A machine from a bounded sample of the labelled ``rows``."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & rows)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {k: min(1.0, per_class / n) for k, n in counts.items()}
    limit = F.when(F.col("toxic") == 1, F.lit(rate.get(1, 0.0))).otherwise(F.lit(rate.get(0, 0.0)))
    sample = known.where(unit_hash(F.col("doc_id")) < limit)  # at most about 2 * per_class rows, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array([terms(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64())), batch.column("toxic").cast(pa.int32())], names=["doc_id", "terms", "toxic"])

    got = map_batches(texts.select("doc_id", "text", "toxic"), run, "doc_id long, terms array<long>, toxic int").toArrow()
    order = np.lexsort((got.column("toxic").to_numpy(), got.column("doc_id").to_numpy()))  # the order of partitions must not matter
    lists, y = got.column("terms").combine_chunks(), got.column("toxic").to_numpy()
    flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy() if len(lists) else np.zeros(1, dtype=np.int64)
    off = off - off[0]
    offset = float(np.log(rate.get(0, 1.0) / rate.get(1, 1.0))) if len(rate) == 2 else 0.0
    return fit([flat[off[i] : off[i + 1]] for i in order], y[order], offset)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Machine, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """A score in [0, 1] for each row of ``docs``, and whether it reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([shared.value.score(t) for t in batch.column("text").to_pylist()])
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", held_out.alias("held_out"), "text"), run, SCHEMA)
