"""Texts as baseline JPEGs and back: an image column whose DC coefficients are the payload.

``encode`` stores each payload byte as one 8x8 grey block, whose DC coefficient (quantiser step 8, AC all zero) is
the byte less 128, so that the DC-only luminance thumbnail is the payload itself, byte for byte. A row holds 192
blocks and ends with a restart marker; payloads of more rows than an image may have go on in further images.

``decode`` is a decoder for any baseline JPEG: it parses the markers, Huffman-decodes the scans and reconstructs the
luminance thumbnail from the DC coefficients. Restart intervals are independent, so all intervals of a batch of
images with like tables are decoded in step, one numpy operation for all of them.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 192
MOST_ROWS = 8191  # 65,535 pixels at most
PAD = 32
#: DC categories 8 to 0 get codes of 1 to 9 bits: with its extra bits each difference takes 9 bits, and the one AC
#: code ("end of block") a tenth.
DC_LENGTHS, DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
AC_LENGTHS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (-len(raw) % ROW if raw else ROW)


def _codewords() -> np.ndarray:
    """Of each difference from -255 to 255: code, extra bits and end of block, in 10 bits."""
    out = np.zeros(511, dtype=np.uint64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        prefix = (1 << (9 - size)) - 2  # ones, then a zero: 9 - size bits
        out[d + 255] = ((prefix << size | (d if d > 0 else d + (1 << size) - 1)) << 1) if size else prefix << 1
    return out


CODEWORDS = _codewords()


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def image(rows: np.ndarray) -> bytes:
    """One JPEG of a plane of samples, ROW to a row."""
    h = len(rows)
    v = rows.astype(np.int16) - 128
    v[:, 1:] -= rows[:, :-1].astype(np.int16) - 128
    c = CODEWORDS[v + 255].reshape(h, ROW // 4, 4)
    whole = c[..., 0] << np.uint64(30) | c[..., 1] << np.uint64(20) | c[..., 2] << np.uint64(10) | c[..., 3]
    coded = whole.astype(">u8").view(np.uint8).reshape(h, ROW // 4, 8)[..., 3:].tobytes()
    step = ROW * 10 // 8
    rst = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    scan = bytearray()
    for k in range(h):
        scan += coded[k * step : (k + 1) * step].replace(b"\xff", b"\xff\x00")
        if k < h - 1:
            scan += rst[k % 8]
    head = b"\xff\xd8" + _marker(0xDB, bytes([0]) + bytes([8] + [1] * 63)) + _marker(0xC0, struct.pack(">BHHB", 8, h * 8, ROW * 8, 1) + bytes([1, 0x11, 0]))
    head += _marker(0xC4, bytes([0x00]) + DC_LENGTHS + DC_SYMBOLS) + _marker(0xC4, bytes([0x10]) + AC_LENGTHS + AC_SYMBOLS)
    head += _marker(0xDD, struct.pack(">H", ROW)) + _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return head + bytes(scan) + b"\xff\xd9"


def media(text: str | None) -> bytes:
    rows = np.frombuffer(payload(text), dtype=np.uint8).reshape(-1, ROW)
    return b"".join(image(rows[k : k + MOST_ROWS]) for k in range(0, len(rows), MOST_ROWS))


@dataclass
class Frame:
    width: int
    height: int
    restart: int
    #: (horizontal, vertical sampling, quantiser step of DC, DC table, AC table) of each component, luminance first.
    parts: tuple[tuple[int, int, int, bytes, bytes], ...]
    segments: list[bytes]

    def grid(self) -> tuple[int, int]:
        """MCUs in a row, and rows of MCUs."""
        h, v = (max(p[i] for p in self.parts) for i in (0, 1))
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def parse(data: bytes) -> list[Frame]:
    """The images of a column value, one after another, each with its end mark."""
    frames: list[Frame] = []
    at, quant, tables, restart = 0, {}, {}, 0
    shape: tuple = ()
    whole = True
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        code = data[at + 1]
        at += 2
        if code == 0xD8:
            quant, tables, restart = {}, {}, 0
        if code in (0xD8, 0xD9):
            if whole != (code == 0xD8):
                raise ValueError("an image that doesn't end")
            whole = code == 0xD9
        if code in (0xD8, 0xD9, 0x01):
            continue
        n = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + n], at + n
        if code == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quant[k] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[65 + 64 * wide :]
        elif code == 0xC4:
            while body:
                m = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + m]
                body = body[17 + m :]
        elif code in (0xC0, 0xC1):
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of 8 bits only")
            shape = (width, height, [body[6 + 3 * i : 9 + 3 * i] for i in range(parts)])
        elif 0xC2 <= code <= 0xCF and code != 0xC8 and code != 0xCC:
            raise ValueError("baseline images only")
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            parts = tuple((c[1] >> 4, c[1] & 15, quant[c[2]], tables[chosen[c[0]] >> 4], tables[0x10 | chosen[c[0]] & 15]) for c in shape[2])
            end = SCAN_END.search(data, at)
            if not end:
                raise ValueError("a scan that doesn't end")
            stop = end.start()
            segments = [s.replace(b"\xff\x00", b"\xff") for s in RESTARTS.split(data[at:stop])]
            frames.append(Frame(shape[0], shape[1], restart, parts, segments))
            at = stop
    if not whole:
        raise ValueError("an image that doesn't end")
    return frames


def lookup(table: bytes) -> np.ndarray:
    """Of each 16 bits that may come next: the length of the code they begin with, times 256, and its symbol."""
    out = np.zeros(1 << 16, dtype=np.int32)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    """Where each segment is being read."""

    def __init__(self, segments: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(segments) + bytes(16), dtype=np.uint8)
        self.window = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.stop = np.cumsum(sizes) * 8
        self.end = len(self.window) * 8 - 1

    def peek(self, on: np.ndarray | slice) -> np.ndarray:
        at = np.minimum(self.at[on], self.end)
        return (self.window[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF).astype(np.int32)


def coefficients(segments: list[bytes], counts: np.ndarray, parts: tuple) -> np.ndarray:
    """The luminance DC coefficients of segments with ``counts`` MCUs each: (segment, MCU, block of the MCU)."""
    bits, most = Bits(segments), int(counts.max())
    single = len(parts) == 1
    blocks = [(i, p) for i, p in enumerate(parts) for _ in range(1 if single else p[0] * p[1])]
    luma = sum(i == 0 for i, _ in blocks)
    tables = {t: lookup(t) for p in parts for t in p[3:]}
    last = np.zeros((len(parts), len(segments)), dtype=np.int32)
    out = np.zeros((len(segments), most, luma), dtype=np.int32)
    order = np.argsort(-counts, kind="stable")
    bits.at, bits.stop, counts = bits.at[order], bits.stop[order], counts[order]
    for k in range(most):
        on = slice(0, int(np.searchsorted(-counts, -k, side="left")))  # those with more than k MCUs
        for b, (i, (_, _, _, dc, ac)) in enumerate(blocks):
            hit = tables[dc][bits.peek(on)]
            bits.at[on] += hit >> 8
            size = hit & 0xFF
            extra = bits.peek(on) >> (16 - size)
            bits.at[on] += size
            last[i, on] += np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
            if i == 0:
                out[on, k, b] = last[0, on]
            hit = tables[ac][bits.peek(on)]
            bits.at[on] += (hit >> 8) + (hit & 15)
            lanes = np.flatnonzero(hit & 0xFF)
            place = (hit[lanes] >> 4 & 15) + 2
            lanes = lanes[place < 64]
            place = place[place < 64]
            while len(lanes):  # AC coefficients: only their length matters
                hit = tables[ac][bits.peek(lanes)]
                bits.at[lanes] += (hit >> 8) + (hit & 15)
                place = place + (hit >> 4 & 15) + 1
                more = ((hit & 0xFF) != 0) & (place < 64)
                lanes, place = lanes[more], place[more]
    spare = bits.stop - bits.at
    if ((spare < 0) | (spare > 7)).any():  # a segment is read to its last byte, and not beyond
        raise ValueError("a segment has not the length that its codes have")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def decode(values: list[bytes]) -> list[tuple[list[np.ndarray], list[Frame]]]:
    """Of each value: the DC-only luminance planes (uint8, a sample per block) and the frames."""
    parsed = [parse(v) for v in values]
    groups: dict[tuple, list[Frame]] = {}
    for f in (f for frames in parsed for f in frames):
        groups.setdefault(f.parts, []).append(f)
    planes: dict[int, np.ndarray] = {}
    for parts, frames in groups.items():
        counts = []
        for f in frames:
            w, h = f.grid()
            step = f.restart or w * h
            counts += [min(step, w * h - i * step) for i in range(len(f.segments))]
        dc = coefficients([s for f in frames for s in f.segments], np.array(counts, dtype=np.int64), parts)
        at = 0
        for f in frames:
            n = len(f.segments)
            (w, h), step = f.grid(), f.restart or f.grid()[0] * f.grid()[1]
            flat = dc[at : at + n, :step].reshape(-1, dc.shape[2])[: w * h]
            hs, vs = (1, 1) if len(parts) == 1 else parts[0][:2]
            plane = flat.reshape(h, w, vs, hs).transpose(0, 2, 1, 3).reshape(h * vs, w * hs)
            samples = np.clip((plane * parts[0][2] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            planes[id(f)] = samples[: -(-f.height // 8), : -(-f.width // 8)]
            at += n
    return [([planes[id(f)] for f in frames], frames) for frames in parsed]


def decoded(values: list[bytes | None]) -> list[tuple[list[np.ndarray], list[Frame]] | None]:
    """:func:`decode`, with None for what isn't a whole baseline image."""
    try:
        return list(decode(values))
    except Exception:  # whatever broken bytes lead to; found again one by one
        if len(values) == 1:
            return [None]
        half = len(values) // 2
        return decoded(values[:half]) + decoded(values[half:])


def thumbnail_hash(planes: list[np.ndarray]) -> str:
    """64 bits in hex: which of 8 x 8 equal fields of the thumbnail are lighter than their mean."""
    p = np.vstack(planes)
    rows = np.add.reduceat(p, np.arange(8) * len(p) // 8, axis=0, dtype=np.int64) if len(p) >= 8 else np.repeat(p.astype(np.int64), -(-8 // len(p)), axis=0)[:8]
    high = np.diff(np.append(np.arange(8) * len(p) // 8, len(p))) if len(p) >= 8 else np.ones(8, dtype=np.int64)
    edges = np.arange(8) * p.shape[1] // 8
    cells = np.add.reduceat(rows, edges, axis=1) / (high[:, None] * np.diff(np.append(edges, p.shape[1]))[None, :])
    return np.packbits(cells > cells.mean()).tobytes().hex()


ENCODED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Payload bytes that are handled at a time.
AT_ONCE = 4_000_000


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= AT_ONCE:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row; a null text is empty."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [int(n or 0) for n in batch.column(2).to_pylist()]
            for a, b in _runs(sizes):
                part = batch.slice(a, b - a)
                values = [media(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes[a:b], pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "n_bytes", "media"])

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.octet_length(text_col).alias("n_bytes"))
    return t.mapInArrow(coded, ENCODED)


def describe(stored: DataFrame) -> DataFrame:
    """What the stored images hold: the payload as read back, digests, dimensions and the thumbnail's hash.

    A broken, progressive or null image, or one that is cut off anywhere before its end mark, has nulls for what can't be
    read. Of several images in a value that ends between two of them, those that are there are read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(2).to_pylist()
            for a, b in _runs([len(m or b"") for m in every]):
                part, values = batch.slice(a, b - a), every[a:b]
                cols: list[list] = [[] for _ in range(6)]
                for m, image in zip(values, decoded(values), strict=True):
                    if image is None or not image[1]:
                        for c, x in zip(cols, (None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), None), strict=True):
                            c.append(x)
                        continue
                    planes, frames = image
                    raw = b"".join(p.tobytes() for p in planes)
                    shape = f"{frames[0].width}x{sum(f.height for f in frames)}"
                    row = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{shape}:{thumbnail_hash(planes)}")
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return stored.mapInArrow(read, FEATURES)


def columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an image and read back: one row per row of ``docs``.

    Null counts as empty, which is one row of spaces. Equal texts give equal values; repeated rows are handled each.
    Other columns are ignored; an empty table gives no rows.
    """
    return describe(encode(docs, id_col, text_col))
