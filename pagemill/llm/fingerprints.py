"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed share of the hash space. Sketches of the same
share merge by union, and the share kept does not depend on a text's length, so containment
between very unequal documents stays unbiased.

Defined results: a null text is empty; an empty text has no shingle and an empty sketch; equal
texts have equal fingerprints; two sketches without any retained hash are alike (1.0) only if
their digests of all shingles agree, else 0.0. A merged sketch has no such digest, and what it says goes by
the hashes retained; a sketch merged with itself is itself. Repeated ids are ordered by their text, a null
id comes first. An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import SLICE, partitions, shingle_hashes

#: One of so many hashes is kept, and so many words make a shingle.
SCALE, WIDTH = 4, 5
_DIGITS = 12


@dataclass(frozen=True)
class Sketch:
    n_shingles: int
    digest: int
    hashes: np.ndarray
    scale: int = SCALE
    whole: bool = True  # number and digest are those of all shingles

    @classmethod
    def of(cls, text: str | None, scale: int = SCALE, width: int = WIDTH) -> Sketch:
        h = np.unique(shingle_hashes(text or "", width))
        kept = h[h < np.uint64((1 << 64) // scale)] >> np.uint64(64 - 4 * _DIGITS)
        return cls(len(h), int(np.bitwise_xor.reduce(h)) if len(h) else 0, np.unique(kept), scale)

    def __str__(self) -> str:
        body = self.hashes.astype(">u8").tobytes().hex()
        cells = np.frombuffer(body.encode(), dtype="S1").reshape(-1, 16)[:, 16 - _DIGITS :].tobytes().decode() if body else ""
        return f"{self.scale}:{self.n_shingles}:{f'{self.digest:016x}' if self.whole else '-'}:{cells}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        scale, n, digest, body = text.split(":")
        cells = [int(body[i : i + _DIGITS], 16) for i in range(0, len(body), _DIGITS)]
        whole = digest != "-"
        return cls(int(n), int(digest, 16) if whole else 0, np.array(cells, dtype=np.uint64), int(scale), whole)

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both shingle sets together (their number is then an estimate)."""
        if self.scale != other.scale:
            raise ValueError("sketches of different scales do not merge")
        if self._same(other):
            return self
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(max(self.n_shingles, other.n_shingles, len(both) * self.scale), 0, both, self.scale, False)

    def common(self, other: Sketch) -> int:
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def _same(self, other: Sketch) -> bool:
        if self.whole and other.whole:
            return self.n_shingles == other.n_shingles and self.digest == other.digest
        return bool(len(self.hashes)) and np.array_equal(self.hashes, other.hashes)

    def jaccard(self, other: Sketch) -> float:
        if self._same(other):
            return 1.0
        both = self.common(other)
        union = len(self.hashes) + len(other.hashes) - both
        return both / union if union else 0.0

    def containment(self, other: Sketch) -> float:
        """The estimated share of this sketch's shingles that ``other`` has."""
        if self._same(other):
            return 1.0
        return self.common(other) / len(self.hashes) if len(self.hashes) else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, kept_in_edited double, kept_in_next double"
)


def _bound_index(key, bounds: list[int], step: int = 64):
    """The number of ``bounds`` (ascending) that are at most ``key``, by a two-level search."""
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    if len(bounds) <= step:
        return F.size(F.filter(longs(bounds), lambda b: b <= key))
    coarse = F.size(F.filter(longs(bounds[::step]), lambda b: b <= key))
    fine = F.size(F.filter(F.slice(longs(bounds), F.greatest((coarse - 1) * step + 1, F.lit(1)), step), lambda b: b <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (pid, ghost, doc_id, text) dealt by ranges of ids, each range followed by the first
    row of the next one as a ghost (the last range by the very first row).

    Only ids are read to find the ranges; whole texts are shuffled once.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 1000 + 100 * n).alias("q")).first().q or []
    bounds = sorted(set(cuts))
    pid = _bound_index(key, bounds) if bounds else F.lit(0)
    firsts = {r.p: r.k for r in rows.select(pid.alias("p"), key.alias("k")).groupBy("p").agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range's ghost goes to the last one
    lookup = lambda m, cast: F.element_at(F.array(*[F.lit(m.get(p)).cast(cast) for p in range(len(bounds) + 1)]), pid + 1)
    places = F.array(F.struct(pid.alias("pid"), F.lit(0).alias("ghost")))
    if firsts:
        also = F.struct(lookup(before, "int").alias("pid"), F.lit(1).alias("ghost"))
        places = F.when(key == lookup(firsts, "long"), F.array_append(places, also)).otherwise(places)
    return rows.select(F.explode(places).alias("at"), "doc_id", "text").select("at.pid", "at.ghost", "doc_id", "text").repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "ghost", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likeness (estimated Jaccard
    similarity of shingle sets) and containments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        waiting: tuple[int | None, str, Sketch] | None = None
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            out: list[tuple] = []
            for ghost, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("ghost", "doc_id", "text")), strict=True):
                if ghost and waiting is None:
                    continue
                sketch = Sketch.of(text, scale, width)
                if waiting is not None:
                    d, t, s = waiting
                    new = edited(t, text)
                    e = Sketch.of(new, scale, width)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((d, len(t), sha, str(s), str(e), s.jaccard(e), s.jaccard(sketch), s.containment(e), s.containment(sketch)))
                waiting = None if ghost else (doc_id, text, sketch)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_next(docs).mapInArrow(run, SCHEMA)
