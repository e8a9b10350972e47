"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own; from the second
chunk on, its matches before the place where a match boundary of the chunk meets one of the text
so far are dropped (the boundaries resynchronise), and the rest is taken over. Every stitched
pre-token is then encoded by byte-pair merges. Decoding joins the raw bytes of the ids.

The pattern only looks ahead, so two scans that share one boundary share all later ones, as far
as neither is cut off; matches near a chunk's end are therefore not counted, and where the
overlap holds no common boundary the settled scan goes on until one is found.

The chunks of a text need nothing of each other until they are stitched; here a task scans those of a text
one after the other, and many texts keep all tasks busy. A text of one chunk or less is one scan.

Defined results: a null text is empty and has no id; repeated rows are encoded alike; texts of
any length are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import map_batches

#: Code points of a chunk and of what it shares with the next.
CHUNK, OVERLAP = 1 << 12, 128
#: A match is certain that ends so many code points before the end of what is seen (the pattern
#: looks one code point ahead, and its longest literal has three).
MARGIN = 8
#: Distinct pre-tokens whose ids a worker remembers.
REMEMBER = 400_000
_loaded: dict[tuple[str, str], Codec] = {}


class _Pieces(dict):
    """Pre-token to its ids as little-endian bytes; forgets all when full."""

    def __init__(self, merge, limit: int) -> None:
        super().__init__()
        self.merge, self.limit = merge, limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = self[piece] = array("I", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()
        return found


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.rx = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = _Pieces(core.encode_single_piece, REMEMBER)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def _scan(self, text: str, begin: int, end: int) -> tuple[list[str], np.ndarray]:
        """The matches that are certain when only ``text[begin:end]`` is seen, and the boundaries
        around them."""
        found = self.rx.findall(text, begin, end)
        edges = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=edges[1:])
        edges += begin
        if end < len(text):
            n = int(np.searchsorted(edges, end - MARGIN, side="right")) - 1
            found, edges = found[: max(n, 0)], edges[: max(n, 0) + 1]
        return found, edges

    def _go_on(self, text: str, begin: int, reach: int) -> tuple[list[str], np.ndarray]:
        """At least one certain match from ``begin`` on."""
        while True:
            found, edges = self._scan(text, begin, min(len(text), begin + reach))
            if found:
                return found, edges
            reach *= 2

    def pre_tokens(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """The pattern's matches over the whole text, found chunk by chunk and stitched."""
        if len(text) <= chunk:
            return self.rx.findall(text)
        parts = [self._scan(text, b, min(len(text), b + chunk + overlap)) for b in range(0, len(text), chunk)]
        out, edges = parts[0]
        for own, own_edges in parts[1:]:
            reach = overlap
            while own_edges[-1] > edges[-1]:
                near = edges[np.searchsorted(edges, own_edges[0]) :]
                meet = near[np.isin(near, own_edges)]
                if len(meet):
                    k, j = np.searchsorted(edges, meet[0]), np.searchsorted(own_edges, meet[0])
                    out[k:] = own[j:]
                    edges = np.concatenate([edges[:k], own_edges[j:]])
                else:  # no common boundary yet: the settled scan goes on
                    more, more_edges = self._go_on(text, int(edges[-1]), reach)
                    out.extend(more)
                    edges = np.concatenate([edges, more_edges[1:]])
                    reach *= 2
        while edges[-1] < len(text):
            more, more_edges = self._go_on(text, int(edges[-1]), chunk)
            out.extend(more)
            edges = np.concatenate([edges, more_edges[1:]])
        return out

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pre_tokens(text, chunk, overlap)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the ids of each text, little-endian unsigned 32-bit integers in a binary."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.load(path, pattern)
        ids = [codec.encode(t or "", chunk, overlap) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the raw bytes of each row's ids; null ids give no bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.load(path, pattern)
        raw = [codec.decode(x or b"") for x in batch.column("ids").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Each text encoded and decoded, as digests of its ids and of the decoded bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.load(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        rows = []
        for text in batch.column("text").to_pylist():
            ids = codec.encode(text or "", chunk, overlap)
            rows.append((len(ids) // 4, sha(ids), sha(codec.decode(ids))))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.record_batch([batch.column("doc_id"), *cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)
