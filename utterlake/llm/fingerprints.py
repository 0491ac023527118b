"""Hashes of words and of runs of words, in numpy, over the bytes of many texts at once.

A word's hash is a polynomial over its bytes, each replaced by a random number, modulo 2^64 and mixed; no Python loop
goes over words, and no table of known words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a part of its own.
PART = 1 << 21
#: Bytes whose terms are in memory at a time.
BLOCK = 1 << 18
_random = np.random.default_rng(20240601)
#: A multiplier for each place in a run, from a fixed seed; odd, so that none loses bits.
MULTIPLIERS = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A number for each byte, none for white space; the same with A-Z as a-z; and the powers of the polynomial's base.
BYTES = _random.integers(1, 2**64, 256, dtype=np.uint64)
INK = np.ones(256, dtype=bool)
INK[[9, 10, 11, 12, 13, 32]] = False
BYTES[~INK] = 0
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
BASE = 0x9E3779B97F4A7C15
POWERS = np.cumprod(np.array([1] + [BASE] * BLOCK, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def grams(w: np.ndarray, size: int, places: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` values."""
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = w[:n] * MULTIPLIERS[places]
    for k in range(1, size):
        h = h + w[k : k + n] * MULTIPLIERS[places + k]
    return mix(h)


@dataclass
class Words:
    """Words of some texts, one after another: ``data`` has their bytes, text i the words first[i] to first[i + 1]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins, with the end."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and at[-1] else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _polynomials(data: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), dtype=np.uint64)
    bounds = np.append(begin, len(data))
    i = 0
    while i < len(begin):
        j = int(np.searchsorted(bounds, begin[i] + BLOCK, side="right")) - 1
        if j > i:
            at = (begin[i:j] - begin[i]).astype(np.int32)
            n = int(bounds[j] - begin[i])
            place = np.arange(n, dtype=np.int32) - np.repeat(at, np.diff(np.append(at, np.int32(n))))
            out[i:j] = np.add.reduceat(table[data[begin[i] : bounds[j]]] * POWERS[place], at)
        else:  # a word that is longer than a block
            j, total = i + 1, 0
            for k in range(int(begin[i]), int(bounds[j]), BLOCK):
                term = table[data[k : min(k + BLOCK, int(bounds[j]))]]
                total += int((term * POWERS[: len(term)]).sum(dtype=np.uint64)) * pow(BASE, k - int(begin[i]), 2**64)
            out[i] = total % 2**64
        i = j
    return mix(out)


def words(column: pa.Array, lower: bool = False) -> Words:
    """The words of a column of texts; null has none. Words are runs of anything but ASCII white space."""
    data, at = _raw(column)
    ink = INK[data]
    fresh = ink.copy()
    fresh[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = at[(at > 0) & (at < len(data))]
    fresh[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    begin, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    first = np.searchsorted(begin, at)
    return Words(data, begin, end, first, _polynomials(data, begin, LOWER if lower else BYTES))


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of ``column``, so that what is made of one stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(size) - size) // most
        cut = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            yield batch.slice(a, b - a)


def numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, one row after another, and how many each row has; read where they lie."""
    flat, sizes = [np.empty(0, kind)], [np.empty(0, np.int64)]
    for c in column.chunks:
        if len(c):
            _, offsets, data = c.buffers()
            at = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
            if at[-1] > at[0]:
                flat.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind))
            sizes.append(np.diff(at) // np.dtype(kind).itemsize)
    return np.concatenate(flat), np.concatenate(sizes)


def split(text: str | None) -> list[bytes]:
    """Words as bytes: bytes.split() knows ASCII white space only, as the contract has it."""
    return (text or "").encode("utf-8", "surrogatepass").split()
