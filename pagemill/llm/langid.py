"""Language ID by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot is a bitmask with a bit for each
language, an n-gram sets its language's bit in several slots, and the AND of these slots returns
every language that contains the n-gram at once. A text's score for a language is the share of
its n-grams with that bit, corrected for the filter's rate of false positives; the language of
the largest share is decided.

Training reads a bounded sample of labelled rows (at most about ``per_language`` of a language,
chosen by a hash of the id); prediction reads every text, whole.

Defined results: a null text or one without a letter is ``und`` with score 0.0; ties go to the
language of more training rows, then to the name that sorts first; a text without any known
n-gram gets the most frequent language with score 0.0; without labelled rows all are ``und``.
Null languages are not learned. Repeated rows are predicted alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import codepoints, map_batches, mix, unit_hash

#: n-gram lengths, slots (a power of two), hash functions, training rows of a language, and the
#: share of a language's n-grams below which one is taken for noise.
SIZES, SLOTS, HASHES, PER_LANGUAGE, LEAST_SHARE = (2, 3, 4), 1 << 21, 3, 3000, 2e-5
UNKNOWN = "und"
_letters = np.zeros(0, dtype=bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(i).isalpha() for i in range(1 << 18)), dtype=bool, count=1 << 18)
    return _letters[np.minimum(points, (1 << 18) - 1)]


def ngrams(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of the n-grams of the lower-cased text, in which every run of other characters
    than letters is one space; and whether it has a letter."""
    c = codepoints(" " + text.lower() + " ")
    ok = _is_letter(c)
    if not ok.any():
        return np.zeros(0, dtype=np.uint64), False
    keep = ok.copy()
    keep[0] = True
    keep[1:] |= ok[:-1]  # the first of a run of other characters stands for all
    c = np.where(ok, c, 32)[keep].astype(np.uint64)
    out, h = [], c.copy()
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n in SIZES:
            out.append(mix(h + np.uint64(n << 56)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), True


def slots(h: np.ndarray, k: int, n_slots: int) -> np.ndarray:
    return ((h >> np.uint64(21 * k)) & np.uint64(n_slots - 1)).astype(np.int64)


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray  # (slots, bytes), a bit for each language
    false_rate: np.ndarray  # of each language

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], order: list[str], n_slots: int = SLOTS) -> Filter:
        bits = np.zeros((n_slots, max(1, -(-len(order) // 8))), dtype=np.uint8)
        fill = np.zeros(len(order))
        for i, lang in enumerate(order):
            own = np.zeros(n_slots, dtype=bool)
            for k in range(HASHES):
                own[slots(grams[lang], k, n_slots)] = True
            bits[own, i // 8] |= np.uint8(1 << (i % 8))
            fill[i] = own.mean()
        return cls(order, bits, fill**HASHES)

    def members(self, h: np.ndarray) -> np.ndarray:
        """The bitmask of all languages that contain each n-gram."""
        found = self.masks[slots(h, 0, len(self.masks))]
        for k in range(1, HASHES):
            found = found & self.masks[slots(h, k, len(self.masks))]
        return found

    def shares(self, h: np.ndarray) -> np.ndarray:
        found = self.members(h)
        hits = np.concatenate([[np.count_nonzero(found[:, i // 8] & np.uint8(1 << (i % 8)))] for i in range(len(self.languages))])
        return np.clip((hits / len(h) - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        h, any_letter = ngrams(text or "")
        if not any_letter or not self.languages:
            return UNKNOWN, 0.0
        if not len(h):
            return self.languages[0], 0.0
        s = self.shares(h)
        best = int(np.argmax(s))
        return self.languages[best], float(s[best])


def train(docs: DataFrame, rows: Column, per_language: int = PER_LANGUAGE, least_share: float = LEAST_SHARE) -> Filter:
    """A filter from the texts and languages of a bounded sample of the ``rows``."""
    labelled = docs.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts, key=lambda x: (-counts[x], x))
    if not order:
        return Filter([], np.zeros((SLOTS, 1), dtype=np.uint8), np.zeros(0))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(rate)
    sample = labelled.where(unit_hash(F.coalesce("doc_id", F.lit(-1)), F.length("text")) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text)[0])
            for lang, parts in by.items():
                seen.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
        for lang, parts in seen.items():
            h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = grams.join(F.broadcast(totals), "lang").where((F.col("n") >= 2) & (F.col("n") >= least_share * F.col("total"))).select("lang", "gram").toArrow()
    lang, gram = np.array(kept.column("lang").to_pylist(), dtype=object), kept.column("gram").to_numpy().view(np.uint64)
    return Filter.build({x: gram[lang == x] for x in order}, order)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Filter, held_out: Column) -> DataFrame:
    """A language and its score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        langs, scores = zip(*got, strict=True)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", held_out.alias("held_out"), "text"), run, SCHEMA)


def accepted(docs: DataFrame, model: Filter, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of ``least`` or more;
    ``lang`` becomes the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        langs = pa.array([lang for lang, _ in got], pa.string())
        keep = pa.array([lang != UNKNOWN and s >= least for lang, s in got], pa.bool_())
        names = batch.schema.names
        return pa.record_batch([langs if n == "lang" else batch.column(n) for n in names], names=names).filter(keep)

    return map_batches(docs, run, docs.schema)
