"""Best-fit packing of tokenised documents into sequences, by bin completion.

Documents are cut into pieces of at most one sequence. Pieces are dealt by a hash into groups of bounded mean size,
whose number follows the number of pieces; each group is packed on its own. Where its packing meets the lower bound,
that loses less than one sequence per group against a packing of all. In a group, best-fit decreasing gives the incumbent; if
it misses the lower bound, a branch-and-bound over bin completions looks for fewer sequences: it enumerates the
undominated fillings around the largest piece that is left and gives up a branch once its waste excludes a better
packing.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SEQUENCE = 4096
END_ID = 1
#: Mean pieces per group; steps of the search, per piece and at least, beyond which the incumbent stands; fillings that are sorted at a time.
GROUP = 16_384
STEPS_PER_PIECE, STEPS = 4, 50_000
CHUNK = 64
#: Bytes of words and their ids, roughly, in each of the two generations that a worker keeps.
CACHE_BYTES = 110_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes.

    This tokenizer never looks across white space, so each distinct white-space-delimited string is encoded once and
    its ids are looked up from then on. Strings are split at ASCII white space only; other white space stays inside
    a string, where the tokenizer itself treats it.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
            try:
                yield b"".join(map(self.known.__getitem__, words))
                continue
            except KeyError:
                pass
            if self.bytes > CACHE_BYTES:  # frequent words come back from the older generation
                self.known, self.older, self.bytes = {"": b""}, self.known, 0
            new = []
            for w in set(words).difference(self.known):
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.known[w] = ids
                    self.bytes += 150 + len(w) + len(ids)
            for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                ids = self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
                self.bytes += 150 + len(w) + len(ids)
            yield b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where longer than a sequence."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        step = SEQUENCE * 4
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length, largest first, goes to the fullest sequence that it fits in."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    mask = 0  # bit r: some sequence has r free places
    for x in sorted(lengths, reverse=True):
        fits = mask >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(x)
        if room > x:
            free.setdefault(room - x, []).append(k)
            mask |= 1 << (room - x)
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Neither fewer than the sum needs, nor than there are lengths of which no two fit together."""
    return max(math.ceil(sum(lengths) / capacity), sum(2 * x > capacity for x in lengths))


def smeared(bits: int, most: int) -> int:
    """Bits moved up by 1 to ``most``, all together."""
    out, wide = bits << 1 if most else 0, 1
    while wide < most:
        step = min(wide, most - wide)
        out, wide = out | out << step, wide + step
    return out


def fillings(room: int, count: dict[int, int], mask: int, together: int, slack: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of ``room`` from the lengths left that leaves at most ``slack``, depth first from the largest.

    ``mask`` has a bit for each length of which ``count`` has some, ``together`` is their sum. A filling is dominated if
    lengths in it, or none, can give way to one that is left, at least as long as they are together, and that fits.
    ``steps`` counts down to where the search ends.
    """

    def undominated(used: list[int], left: int) -> bool:
        ones, several, rest = 1, 0, mask
        for y in used:
            several |= several << y | (ones & ~1) << y
            ones |= 1 << y
        for y, n in Counter(used).items():
            if count[y] == n:
                rest &= ~(1 << y)
        return not rest & (smeared(ones | several, left) | several)

    def deeper(limit: int, used: list[int], left: int, others: int) -> Iterator[tuple[int, ...]]:
        m = mask & ((2 << min(limit, left)) - 1)
        while m and steps[0] > 0 and left - slack <= others:
            x = m.bit_length() - 1
            m ^= 1 << x
            if not used or used[-1] != x or used.count(x) < count[x]:
                steps[0] -= 1
                yield from deeper(x, [*used, x], left - x, others - x)
        if left <= slack and undominated(used, left):
            yield tuple(used)

    return deeper(room, [], room, together)


def bin_completion(lengths: list[int], capacity: int, steps: int) -> list[list[int]]:
    """As few bins as the search finds within ``steps`` steps; never more than best-fit decreasing, and the fewest if it ends before.

    Branch and bound: the largest length left opens a bin, whose undominated fillings are tried, the fullest of each
    CHUNK first. A filling may waste only what a packing with one bin less than the incumbent could.
    """
    incumbent = best_fit(lengths, capacity)
    bound, total = lower_bound(lengths, capacity), sum(lengths)
    if len(incumbent) <= bound:
        return incumbent
    count, mask, together = dict(Counter(lengths)), 0, total
    for x in count:
        mask |= 1 << x
    bins: list[tuple[int, ...]] = []
    budget = [steps]
    #: Of each open level: the largest, its fillings that aren't sorted yet, those that are, fullest last, and the waste before it.
    stack: list[tuple[int, Iterator[tuple[int, ...]], list[tuple[int, ...]], int]] = []

    def take(xs: tuple[int, ...], n: int) -> None:
        nonlocal mask, together
        for x in xs:
            count[x] -= n
            together -= n * x
            mask = mask | 1 << x if count[x] else mask & ~(1 << x)

    def spare(waste: int) -> int:
        return (len(incumbent) - 1) * capacity - total - waste

    waste, down = 0, True
    while budget[0] > 0:
        if down and not mask:
            incumbent = [list(b) for b in bins]
            if len(incumbent) <= bound:
                break
            down = False
        if down:
            budget[0] -= 1
            top = mask.bit_length() - 1
            take((top,), 1)
            stack.append((top, fillings(capacity - top, count, mask, together, spare(waste), budget), [], waste))
        elif not stack:
            break
        else:
            take(bins.pop(), -1)
            take((stack[-1][0],), 1)
        top, more, ready, waste = stack[-1]
        down = False
        while True:
            if not ready:
                ready.extend(sorted(islice(more, CHUNK), key=lambda f: (sum(f), f)))
                if not ready:
                    break
            xs = ready.pop()
            lost = capacity - top - sum(xs)
            if lost <= spare(waste):
                take(xs, 1)
                bins.append((top, *xs))
                waste += lost
                down = True
                break
        if not down:
            take((top,), -1)
            stack.pop()
            if not stack:
                break
    return incumbent


def pack(cut: DataFrame, groups: int) -> DataFrame:
    """``pieces`` with sequence_id and offset. Each of ``groups`` groups is packed on its own."""

    def packed(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        lengths = table["length"].tolist()
        bins = bin_completion(lengths, SEQUENCE, max(STEPS, STEPS_PER_PIECE * len(lengths)))
        slots: dict[int, list[tuple[int, int]]] = {}
        for k, b in enumerate(bins):
            at = 0
            for x in b:
                slots.setdefault(x, []).append((k, at))
                at += x
        order = table.sort_values(["length", "doc_id", "piece"], kind="stable").index
        placed = {i: slots[table.at[i, "length"]].pop() for i in order}
        table["sequence_id"] = [(int(key[0]) << 40) + placed[i][0] for i in table.index]
        table["offset"] = [placed[i][1] for i in table.index]
        return table.drop(columns="__group")

    # The row's number deals repeated rows to all groups.
    keyed = cut.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return keyed.groupBy("__group").applyInPandas(packed, f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece of every row of ``docs``, with its sequence and its place there.

    Null and empty texts are the end id alone. Rows that repeat are packed each. Other columns are ignored; an empty
    table gives no rows.
    """
    cut = written(pieces(docs, id_col, text_col, path), "packing-pieces")
    return pack(cut, max(1, math.ceil(cut.count() / GROUP)))
