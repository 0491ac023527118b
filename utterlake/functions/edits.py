"""Edit distances of batches of pairs: bit vectors of the alignment table along its diagonal, many pairs at a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a column's band, the rows below the diagonal among them, narrow ones first; pairs, and characters of padded pairs, that are worked on at once.
BANDS, ROWS, CELLS = ((16, 7, np.uint16), (64, 31, np.uint64)), 2048, 1 << 20

Codes = tuple[np.ndarray, np.ndarray]


def char_codes(texts: pa.Array) -> Codes:
    """(code points of all texts, where each text begins and the last ends); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if whole.max(initial=0) < 128:
        return whole, ends - ends[0]
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(whole.tobytes().decode().encode("utf-32-le"), np.uint32), np.append(0, np.cumsum(sizes))


def spaced_codes(codes: Codes) -> Codes:
    """The codes with a space between any two of a text."""
    flat, ends = codes
    out = np.full(2 * len(flat), 32, flat.dtype)
    out[::2] = flat
    sizes = np.diff(ends)
    last = np.repeat(np.zeros(len(sizes), bool), 2 * sizes)
    last[2 * ends[1:][sizes > 0] - 1] = True
    return out[~last], np.append(0, np.cumsum(np.maximum(2 * sizes - 1, 0)))


def word_codes(a: pa.Array, b: pa.Array) -> tuple[Codes, Codes]:
    """The words of two columns, equal words by equal numbers."""
    both = pa.chunked_array([pc.fill_null(x.cast(pa.large_string()), "") for x in (a, b)]).combine_chunks()
    parts = pc.ascii_split_whitespace(both)  # what Java's \s parts by
    words, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(there))[ends]
    codes = words.dictionary_encode().indices.to_numpy()[there].astype(np.uint32)
    half = ends[len(a)]
    return (codes[:half], ends[: len(a) + 1]), (codes[half:], ends[len(a) :] - half)


def padded(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: int, after: int, fill: int, kind: type) -> np.ndarray:
    """(row, place): each piece of ``flat`` from place ``before`` on, ``fill`` around it and ``after`` of it behind the longest."""
    out = np.full((len(starts), before + int(sizes.max(initial=0)) + after), fill, kind)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(starts)), sizes), before + at] = flat[np.repeat(starts, sizes) + at].astype(kind)
    return out


def free_code(a: np.ndarray, b: np.ndarray) -> tuple[int, type]:
    """A code that, like the one below it, neither has, and the type that holds it."""
    top = max(int(a.max(initial=0)), int(b.max(initial=0))) + 2
    return top, np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32


def band(a: Codes, b: Codes, rows: np.ndarray, bits: int, below: int, word: type) -> np.ndarray:
    """Distances of ``rows``, which lie in falling order of ``b``'s length; exact where they and the difference of lengths are at most ``below``.

    A bit stands for the difference of two cells one above the other, in the rows of ``a`` around the diagonal; the band goes
    down by a row with each character of ``b``. The cell at its lower edge is known throughout, that of the whole texts follows
    from the differences between the two.
    """
    top, kind = free_code(a[0], b[0])
    size_a, size_b = np.diff(a[1])[rows], np.diff(b[1])[rows]
    longest = int(size_b.max(initial=0))
    # Row r of the table is place bits - below - 1 + r - 1; what lies beyond a text equals nothing.
    p = padded(a[0], a[1][rows], size_a, bits - below - 1, max(0, longest + below + 1 - int(size_a.max(initial=0))), top, kind)
    t = np.ascontiguousarray(padded(b[0], b[1][rows], size_b, 0, 0, top - 1, kind).T)
    out = np.zeros(len(rows), np.int64)
    one = word(1)
    vp = np.full(len(rows), ~((one << word(bits - below - 1)) - one), word)
    vn, last = np.zeros(len(rows), word), np.full(len(rows), below, np.int64)

    def ended(x: slice) -> None:
        """Back from the lower edge to the row of the text's end."""
        rest = np.clip(size_b[x] + below - size_a[x], 0, bits - 2).astype(word)
        mask = (~word(0) << (word(bits - 1) - rest)) & ~(one << word(bits - 1))  # the last bit is a row further
        out[x] = last[x] - np.bitwise_count(vp[x] & mask).astype(np.int64) + np.bitwise_count(vn[x] & mask)

    alive = len(rows)
    for i in range(longest + 1):
        keep = int(np.searchsorted(-size_b[:alive], -i, "left"))  # rows whose text has more than i characters
        if keep < alive:
            ended(slice(keep, alive))
            alive = keep
        if not alive:
            break
        x = np.packbits(p[:alive, i : i + bits] == t[i, :alive, None], axis=1, bitorder="little").view(word).ravel()
        v, w = vp[:alive], vn[:alive]
        d0 = (((x & v) + v) ^ v) | x | w
        hp, hn = w | ~(d0 | v), d0 & v
        last[:alive] += (d0 >> word(bits - 1)) == 0
        d0 >>= one
        vp[:alive], vn[:alive] = hn | ~(d0 | hp), d0 & hp
    return out


def far_apart(a: list, b: list) -> int:
    """Distance of one pair of lists by a column of bits as long as ``a``, whatever it is."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    vp, vn = whole, 0
    for c in b:
        x = places.get(c, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp, hn = vn | whole & ~(d0 | vp), d0 & vp
        found += bool(hp & last) - bool(hn & last)
        hp, hn = (hp << 1 | 1) & whole, hn << 1 & whole
        vp, vn = hn | whole & ~(d0 | hp), d0 & hp
    return found


def replaced(a: Codes, b: Codes, rows: np.ndarray) -> np.ndarray:
    """Distances of ``rows``, pairs of equal length, where their unequal places are certain to be the least edits, else -1.

    There can't be more edits than unequal places. Nor fewer, if no character of one text's unequal places is among those of
    the other: each has to be edited on its own. At most two unequal places are always that many edits.
    """
    sizes = np.diff(a[1])[rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x, y = a[0][np.repeat(a[1][rows], sizes) + within], b[0][np.repeat(b[1][rows], sizes) + within]
    other = np.flatnonzero(x != y)
    row = row[other]
    out = np.bincount(row, minlength=len(rows)).astype(np.int64)
    keys = [row.astype(np.int64) << 32 | c[other].astype(np.int64) for c in (x, y)]
    shared = np.zeros(len(rows), bool)
    shared[np.intersect1d(*keys) >> 32] = True
    return np.where(shared & (out > 2), -1, out)


def shortened(a: Codes, b: Codes, rows: np.ndarray) -> np.ndarray:
    """Whether the second text of each of ``rows``, which lie in falling order of ``a``'s length, is the first with characters left out.

    Their distance is the difference of their lengths then: there can't be fewer edits.
    """
    size_a, size_b = np.diff(a[1])[rows], np.diff(b[1])[rows]
    # A pointer that is past its text's end may go on in the next one's; behind the last is what equals nothing.
    top, kind = free_code(a[0], b[0])
    first, longer, shorter = b[1][rows], a[1][rows], np.append(b[0].astype(kind), kind(top))
    at, longer = first.copy(), longer.copy()
    alive = np.searchsorted(-size_a, -np.arange(int(size_a.max(initial=0))), "left")  # rows whose text has more characters than that
    for n in alive:
        at[:n] += shorter.take(at[:n], mode="clip") == a[0].take(longer[:n], mode="clip")
        longer[:n] += 1
    return at - first >= size_b


def batches(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """``rows`` by falling size, as many at once as fit."""
    rows = rows[np.argsort(-sizes[rows], kind="stable")]
    k = 0
    while k < len(rows):
        n = min(ROWS, max(1, CELLS // int(sizes[rows[k]] + 64)))
        yield rows[k : k + n]
        k += n


def distances(a: Codes, b: Codes) -> np.ndarray:
    """Edit distance of each pair: at once where characters were only replaced or only left out, by the band where that is enough, else by whole columns."""
    size_a, size_b = np.diff(a[1]), np.diff(b[1])
    out = np.full(len(size_a), -1, np.int64)
    even = np.flatnonzero(size_a == size_b)
    out[even] = replaced(a, b, even)
    for x, y, size, rows in ((a, b, size_a, size_a > size_b), (b, a, size_b, size_a < size_b)):
        for k in batches(np.flatnonzero(rows), size):
            out[k] = np.where(shortened(x, y, k), size[k] - np.diff(y[1])[k], -1)
    far, apart = out < 0, np.abs(size_a - size_b)
    for bits, below, word in BANDS:
        for k in batches(np.flatnonzero(far & (apart <= below)), size_b):
            out[k] = band(a, b, k, bits, below, word)
            far[k] = out[k] > below
    for k in np.flatnonzero(far):
        out[k] = far_apart(a[0][a[1][k] : a[1][k + 1]].tolist(), b[0][b[1][k] : b[1][k + 1]].tolist())
    return out


def measured(a: pa.Array, b: pa.Array, unit: str = "char") -> pa.Array:
    """Edit distance of two columns by characters, by characters with spaces between (``spaced``) or by words; null where either is."""
    same = pc.equal(a, b)
    rows = np.flatnonzero(pc.fill_null(pc.invert(same), False).to_numpy(zero_copy_only=False))
    x, y = a.take(pa.array(rows)), b.take(pa.array(rows))
    if unit == "word":
        x, y = word_codes(x, y)
    else:
        x, y = char_codes(x), char_codes(y)
        if unit == "spaced":
            x, y = spaced_codes(x), spaced_codes(y)
    out = np.zeros(len(a), np.int32)
    out[rows] = distances(x, y)
    return pa.array(out, mask=pc.is_null(same).to_numpy(zero_copy_only=False))
