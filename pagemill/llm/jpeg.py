"""Media columns: progressive JPEG.

``decode`` accumulates spectral-selection and successive-approximation scans into coefficient
arrays, inverse-transforms them in numpy, upsamples chroma and returns a full-resolution RGB
tensor. It reads any Huffman-coded progressive file of 8-bit samples with one or three
components, restart intervals included. Scans whose codes all have one width, as ``pack`` writes
them, are read as bit fields at once after that has been verified; all others symbol by symbol.

``pack`` stores bytes losslessly in the format's unit, the quantised coefficient: each block of 64
bytes is one 8 x 8 block with a quantisation of one. An AC byte b is the coefficient of eight
bits with the very bits b (b from 128 on, b - 255 below), so every AC symbol is alike and has a
one-bit code; half a DC byte is added to 256, with a sign that alternates from block to block,
so that all differences have ten bits.

The inverse transform is exact integer arithmetic in doubles, so that equal files have equal
pixels whatever the batch.

Defined results: a null text is empty; an empty payload is one block of zeros; repeated rows have
equal values; texts of any length are stored whole; an empty table gives an empty result; other
columns are ignored. ``decode`` raises ValueError for what is no progressive JPEG.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import map_batches


def _zigzag() -> np.ndarray:
    """The natural position of the k-th coefficient: diagonals, in alternating directions."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_SHIFT = 24


def _kernel() -> np.ndarray:
    """(64, 64): natural coefficient to pixel, in fixed point."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    d = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.rint(np.einsum("ux,vy->uvxy", d, d).reshape(64, 64) * (1 << _SHIFT))


_KERNEL = _kernel()
_KERNEL_ZZ = _KERNEL[ZIGZAG]


@dataclass
class Huffman:
    """Codes as in a DHT segment: numbers of codes by length, symbols in code order."""

    counts: tuple[int, ...]
    symbols: bytes

    def __post_init__(self) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        code, i = 0, 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                self.codes[length, code] = self.symbols[i]
                code, i = code + 1, i + 1
            code <<= 1

    def segment(self, kind: int, slot: int) -> bytes:
        body = bytes([kind << 4 | slot, *self.counts]) + self.symbols
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks, in whole units
    down: int = 0
    own_across: int = 0  # blocks that hold samples
    own_down: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), dtype=np.int32))


@dataclass
class Image:
    height: int
    width: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comments: list[bytes]

    def planes(self) -> list[np.ndarray]:
        """Each component's samples at its own resolution."""
        out = []
        for c in self.components:
            values = c.coefficients.astype(np.float64) * self.quants[c.quant]
            pixels = np.floor((values @ _KERNEL_ZZ + (1 << (_SHIFT - 1))) / (1 << _SHIFT)) + 128
            pixels = np.clip(pixels, 0, 255).astype(np.uint8).reshape(c.down, c.across, 8, 8)
            out.append(pixels.transpose(0, 2, 1, 3).reshape(8 * c.down, 8 * c.across))
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3), chroma upsampled by replication."""
        top_h, top_v = max(c.h for c in self.components), max(c.v for c in self.components)
        full = []
        for c, p in zip(self.components, self.planes(), strict=True):
            p = p.repeat(top_v // c.v, axis=0) if top_v > c.v else p
            p = p.repeat(top_h // c.h, axis=1) if top_h > c.h else p
            full.append(p[: self.height, : self.width].astype(np.int32))
        if len(full) == 1:
            return np.repeat(full[0].astype(np.uint8)[:, :, None], 3, axis=2)
        y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
        y += 1 << 15
        out = np.empty((self.height, self.width, 3), dtype=np.uint8)
        out[:, :, 0] = np.clip((y + 91881 * cr) >> 16, 0, 255)
        out[:, :, 1] = np.clip((y - 22554 * cb - 46802 * cr) >> 16, 0, 255)
        out[:, :, 2] = np.clip((y + 116130 * cb) >> 16, 0, 255)
        return out


class _Bits:
    """The bits of one restart interval."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist()
        self.at = 0

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


@dataclass
class _Scan:
    parts: list[tuple[Component, int, int]]  # component, DC and AC table
    first: int
    last: int
    high: int
    low: int
    restart: int
    dc: dict[int, Huffman]
    ac: dict[int, Huffman]

    def blocks(self) -> list[list[tuple[int, int]]]:
        """(part, block) by unit, in coding order."""
        if len(self.parts) == 1:
            c = self.parts[0][0]
            return [[(0, r * c.across + x)] for r in range(c.own_down) for x in range(c.own_across)]
        c0 = self.parts[0][0]
        return [
            [(i, (my * c.v + v) * c.across + mx * c.h + h) for i, (c, _, _) in enumerate(self.parts) for v in range(c.v) for h in range(c.h)]
            for my in range(c0.down // c0.v)
            for mx in range(c0.across // c0.h)
        ]

    def at_once(self, data: bytes) -> bool:
        """Read a scan of one component and no restarts whose codes all are its table's one-bit
        code (or, for a first DC, the two-bit code that makes up for a shorter value); False, and
        nothing is read, if it is not of that form."""
        c, dc, ac = self.parts[0]
        if len(self.parts) > 1 or self.restart or (c.own_across, c.own_down) != (c.across, c.down):
            return False
        n, co = c.across * c.down, c.coefficients
        raw = np.frombuffer(data, dtype=np.uint8)
        if self.first == 0:
            if self.high:
                if len(raw) != -(-n // 8):
                    return False
                co[:, 0] |= np.unpackbits(raw)[:n].astype(np.int32) << self.low
                return True
            codes = self.dc[dc].codes
            size = codes.get((1, 0), 0)
            if size < 2 or size > 14 or codes.get((2, 2)) != size - 1 or len(raw) != -(-n * (size + 1) // 8):
                return False
            bits = np.unpackbits(raw)[: n * (size + 1)].reshape(n, size + 1)
            if bits[1:, 0].any() or not (bits[0, 0] == 1 and bits[0, 1] == 0):
                return False
            v = bits[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            v = np.where(bits[:, 1] == 1, v, v - (1 << size) + 1)
            v[0] = v[0] + (1 << size) - 1  # size - 1 bits, of which the first gives the sign
            v[0] = v[0] if bits[0, 2] else v[0] - (1 << (size - 1)) + 1
            co[:, 0] = np.cumsum(v) << self.low
            return True
        width = self.last - self.first + 1
        symbol = self.ac[ac].codes.get((1, 0))
        if self.high == 0:
            if symbol != 7 or len(raw) != n * width or (raw & 0x80).any():
                return False
            v = raw.astype(np.int32).reshape(n, width)
            co[:, self.first : self.last + 1] = np.where(v >= 64, v, v - 127) << self.low
            return True
        band = co[:, self.first : self.last + 1]
        if symbol != 0 or len(raw) != -(-n * (width + 1) // 8) or not band.all():
            return False
        bits = np.unpackbits(raw)[: n * (width + 1)].reshape(n, width + 1)
        if bits[:, 0].any():
            return False
        more = bits[:, 1:].astype(np.int32) << self.low
        band += np.where(band > 0, more, -more)
        return True

    def by_symbol(self, pieces: list[bytes]) -> None:
        units = self.blocks()
        step = self.restart or len(units)
        for piece, k in zip(pieces, range(0, max(1, len(units)), max(1, step)), strict=False):
            bits, before, run = _Bits(piece), [0] * len(self.parts), 0
            for unit in units[k : k + step]:
                for part, block in unit:
                    c, dc, ac = self.parts[part]
                    co = c.coefficients[block]
                    if self.first == 0:
                        if self.high:
                            co[0] |= bits.bit() << self.low
                        else:
                            before[part] += bits.value(bits.symbol(self.dc[dc]))
                            co[0] = before[part] << self.low
                    elif self.high == 0:
                        run = self._first(bits, co, self.ac[ac], run)
                    else:
                        run = self._refine(bits, co, self.ac[ac], run)

    def _first(self, bits: _Bits, co: np.ndarray, table: Huffman, run: int) -> int:
        if run:
            return run - 1
        k = self.first
        while k <= self.last:
            r, s = divmod(bits.symbol(table), 16)
            if s:
                k += r
                co[k] = bits.value(s) * (1 << self.low)
                k += 1
            elif r == 15:
                k += 16
            else:
                return (1 << r) + bits.take(r) - 1
        return 0

    def _refine(self, bits: _Bits, co: np.ndarray, table: Huffman, run: int) -> int:
        one, k = 1 << self.low, self.first

        def correct(k: int) -> None:
            if bits.bit() and not abs(int(co[k])) & one:
                co[k] += one if co[k] > 0 else -one

        if not run:
            while k <= self.last:
                r, s = divmod(bits.symbol(table), 16)
                new = 0
                if s:
                    new = one if bits.bit() else -one
                elif r != 15:
                    run = (1 << r) + bits.take(r)
                    break
                while k <= self.last:
                    if co[k]:
                        correct(k)
                    elif r:
                        r -= 1
                    else:
                        if new:
                            co[k] = new
                        k += 1
                        break
                    k += 1
        if run:
            for j in range(k, self.last + 1):
                if co[j]:
                    correct(j)
            run -= 1
        return run


def _pieces(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of the entropy-coded data from ``at`` on, and where they end."""
    pieces, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            at = len(data)
            break
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(data[begin:at])
            at = begin = at + 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            break
    pieces.append(data[begin:at])
    return [p.replace(b"\xff\x00", b"\xff") for p in pieces], at


def decode(data: bytes) -> Image:
    """The coefficients and frame of a progressive JPEG file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, image, restart = 2, None, 0
    quants: dict[int, np.ndarray] = {}
    tables: tuple[dict[int, Huffman], dict[int, Huffman]] = ({}, {})
    comments: list[bytes] = []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDB:
            while body:
                wide, slot = divmod(body[0], 16)
                n = 128 if wide else 64
                quants[slot] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                kind, slot = divmod(body[0], 16)
                n = sum(body[1:17])
                tables[kind][slot] = Huffman(tuple(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise ValueError("only one or three components of 8 bits")
            comps = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            top_h, top_v = max(c.h for c in comps), max(c.v for c in comps)
            if n == 1:
                comps[0].h = comps[0].v = top_h = top_v = 1
            for c in comps:
                c.across, c.down = -(-width // (8 * top_h)) * c.h, -(-height // (8 * top_v)) * c.v
                c.own_across, c.own_down = -(-(-(-width * c.h // top_h)) // 8), -(-(-(-height * c.v // top_v)) // 8)
                c.coefficients = np.zeros((c.across * c.down, 64), dtype=np.int32)
            image = Image(height, width, comps, quants, comments)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("no progressive Huffman-coded file")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            n = body[0]
            by_id = {c.ident: c for c in image.components}
            parts = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            scan = _Scan(parts, first, last, approx >> 4, approx & 15, restart, *tables)
            pieces, at = _pieces(data, at)
            if len(pieces) > 1 or not scan.at_once(pieces[0]):
                scan.by_symbol(pieces)
    if image is None:
        raise ValueError("no frame")
    return image


_DC, _AC_FIRST, _AC_REFINE = Huffman((1, 1, *[0] * 14), bytes([10, 9])), Huffman((1, *[0] * 15), bytes([7])), Huffman((1, *[0] * 15), bytes([0]))
_TABLES = _DC.segment(0, 0) + _AC_FIRST.segment(1, 0) + _AC_REFINE.segment(1, 1)
_QUANT = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
_JFIF = b"\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
_BANDS = ((1, 5), (6, 63))
_NAME = b"payload "
_MOST = 65535 // 16  # units across or down
_DC_WEIGHTS = np.arange(9, -1, -1)


def _scan(component: int, ac: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return bytes([0xFF, 0xDA, 0, 8, 1, component, ac, first, last, high << 4 | low]) + data


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones, an 0xff stuffed with a zero."""
    out = np.packbits(bits)
    if len(bits) % 8:
        out[-1] |= (1 << (8 - len(bits) % 8)) - 1
    return out.tobytes().replace(b"\xff", b"\xff\x00")


def pack(payload: bytes) -> bytes:
    """A progressive JPEG file (4:2:0) that holds ``payload``, a multiple of 64 bytes."""
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = len(payload) // 64
    units = -(-n // 6)
    across = min(_MOST, max(1, int(np.ceil(np.sqrt(units)))))
    down = -(-units // across)
    if down > _MOST:
        raise ValueError("the payload is too long for one image")
    units = across * down
    blocks = np.zeros((6 * units, 64), dtype=np.uint8)
    blocks[:n] = np.frombuffer(payload, dtype=np.uint8).reshape(n, 64)
    note = _NAME + str(len(payload)).encode()
    out = [b"\xff\xd8", _JFIF, b"\xff\xfe", struct.pack(">H", len(note) + 2), note, _QUANT]
    out.append(struct.pack(">BBHBHHB", 0xFF, 0xC2, 17, 8, 16 * down, 16 * across, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00" + _TABLES)
    comps = [(1, blocks[: 4 * units]), (2, blocks[4 * units : 5 * units]), (3, blocks[5 * units :])]
    refine = []
    for c, b in comps:
        dc = 256 + (b[:, 0] >> 1).astype(np.int32)
        dc[1::2] *= -1
        diff = np.diff(dc, prepend=0)
        value = np.where(diff < 0, diff + 1023, diff)
        bits = np.zeros((len(b), 11), dtype=np.uint8)
        bits[:, 1:] = value[:, None] >> _DC_WEIGHTS & 1
        bits[0] = [1, 0, *(int(diff[0]) >> np.arange(8, -1, -1) & 1)]
        out.append(_scan(c, 0, 0, 0, 0, 1, _packed(bits.ravel())))
        refine.append(_scan(c, 0, 0, 0, 1, 0, _packed(b[:, 0] & 1)))
        low = (b ^ (b < 128)) & 1  # of the magnitude
        for first, last in _BANDS:
            out.append(_scan(c, 0, first, last, 0, 1, (b[:, first : last + 1] >> 1).tobytes()))
            bits = np.zeros((len(b), last - first + 2), dtype=np.uint8)
            bits[:, 1:] = low[:, first : last + 1]
            refine.append(_scan(c, 1, first, last, 1, 0, _packed(bits.ravel())))
    return b"".join([*out, *refine, b"\xff\xd9"])


def unpack(image: Image) -> bytes:
    """The payload of a file that ``pack`` has written."""
    size = next(int(c[len(_NAME) :]) for c in image.comments if c.startswith(_NAME))
    co = np.concatenate([c.coefficients for c in image.components])[: size // 64]
    out = np.where(co > 0, co, co + 255).astype(np.uint8)
    dc = co[:, 0]
    out[:, 0] = ((np.abs(dc >> 1) - 256) << 1) | (dc & 1)
    return out.tobytes()


def feature(rgb: np.ndarray) -> str:
    """Height, width, mean of each channel in thousandths, and the signs of an 8 x 8 grid of green
    means against their median, in hexadecimal. Integer arithmetic only."""
    h, w, _ = rgb.shape
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (h * w)
    g = rgb[: h // 8 * 8, : w // 8 * 8, 1].reshape(8, h // 8, 8, w // 8).sum(axis=(1, 3), dtype=np.int64).ravel()
    bits = np.packbits(g > np.sort(g)[32])
    return f"{h}x{w}:{sums[0]},{sums[1]},{sums[2]}:{bits.tobytes().hex()}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a progressive JPEG file."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, pack(p)) for n, p in map(padded, batch.column("text").to_pylist())]
        n, media = zip(*rows, strict=True)
        return pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb): the decoded tensor of each file in the column ``media``; all
    null for a null file."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [decode(m).rgb() if m is not None else None for m in batch.column("media").to_pylist()]
        size = lambda i: pa.array([None if x is None else x.shape[i] for x in found], pa.int32())
        return pa.record_batch([batch.column("doc_id"), size(0), size(1), pa.array([None if x is None else x.tobytes() for x in found], pa.binary())], names=["doc_id", "height", "width", "rgb"])

    return map_batches(media.select("doc_id", "media"), run, "doc_id long, height int, width int, rgb binary")


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored, read back from the stored bytes, and described."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for n, payload in map(padded, batch.column("text").to_pylist()):
            media = pack(payload)
            image = decode(media)
            back = unpack(image)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(image.rgb())))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.record_batch([batch.column("doc_id"), *cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)
