"""Vector codes of few bytes: a codebook per part, trained by rounds of exact assignment, with bounds that skip rescans.

Entries of a codebook are taken in groups. For each vector's part and each group a lower bound on the distance to the
group's nearest entry is kept with the round in which it was measured. Since then an entry has moved by the norm of the
sum of its steps, which the history of codebooks gives at once and which is at most the sum of the steps' norms. A
group is measured anew only where its bound, less the largest such displacement in it, doesn't exceed the distance to
the nearest entry known. Vectors stay where they lie: nothing but an entry's sums is shuffled, and the driver holds
codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .vectors import EXACT, common_length, exact_array, finite, matrix

#: Fixed values of the contract: scale of a component, parts of a vector, entries of a codebook, rounds of training.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Neighbouring entries that share a bound.
GROUP = 16
#: Components from this size on have no long of their own.
MOST = 2.0**51
#: Relative slack that keeps rounded bounds on the safe side.
SLACK = 1e-9


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


@dataclass
class Bounds:
    """Per row, part and group: the distance to the group's nearest entry when it was measured, rounded down, and that round."""

    low: np.ndarray
    stamp: np.ndarray


def small(x: np.ndarray, book: np.ndarray) -> bool:
    """True where squared distances and their terms are integers that doubles hold exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    return x.shape[1] * (2 * most) ** 2 < 2**53


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries: by products of doubles where these are exact, else in integers without a bound."""
    if small(x, book):
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), book.astype(object)
    return np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1)


def floor32(x: np.ndarray) -> np.ndarray:
    v = x.astype(np.float32)
    return np.maximum(np.where(v.astype(np.float64) > x, np.nextafter(v, np.float32(0)), v), np.float32(0))


def displaced(history: list[np.ndarray], groups: int) -> np.ndarray:
    """(round, group): how far the last codebook's entries lie from that round's at most, within a group."""
    now = history[-1].astype(np.float64)
    far = [np.sqrt(((now - old.astype(np.float64)) ** 2).sum(axis=1)) for old in history]
    padded = np.zeros((len(far), groups * GROUP))
    padded[:, : len(now)] = far
    return padded.reshape(len(far), groups, GROUP).max(axis=2)


def assign(x: np.ndarray, history: list[np.ndarray], code: np.ndarray | None, b: Bounds | None) -> tuple[np.ndarray, np.ndarray, Bounds, int]:
    """(nearest entry, its squared distance, bounds, distances computed) of one part of a batch; ties go to the lower index.

    ``code`` and ``b`` are those of an earlier round, or None. The group of the entry that was nearest is measured
    first; what that leaves as the smallest distance is what other groups' bounds have to exceed.
    """
    book, now = history[-1], len(history) - 1
    n, groups = len(x), -(-len(book) // GROUP)
    kind = np.int64 if small(x, book) else object
    best, entry = np.zeros(n, kind), np.full(n, -1)
    b = Bounds(np.zeros((n, groups), np.float32), np.zeros((n, groups), np.uint8)) if b is None else Bounds(b.low.copy(), b.stamp.copy())
    own = None if code is None else code // GROUP
    moved, done = displaced(history, groups), 0

    def measure(rows: np.ndarray, g: int) -> None:
        nonlocal done
        if not len(rows):
            return
        d = squared(x[rows], book[g * GROUP : (g + 1) * GROUP])
        done += d.size
        at = d.argmin(axis=1)
        near, k = d[np.arange(len(rows)), at], at + g * GROUP
        b.low[rows, g] = floor32(np.sqrt(near.astype(np.float64)) * (1 - SLACK))
        b.stamp[rows, g] = now
        better = (entry[rows] < 0) | (near < best[rows]) | ((near == best[rows]) & (k < entry[rows]))
        best[rows[better]], entry[rows[better]] = near[better], k[better]

    if own is not None:
        for g in range(groups):
            measure(np.flatnonzero(own == g), g)
    for g in range(groups):
        if own is None:
            measure(np.arange(n), g)
            continue
        low = b.low[:, g].astype(np.float64) - moved[b.stamp[:, g], g] * (1 + SLACK)
        open_ = (own != g) & (low <= np.sqrt(best.astype(np.float64)) * (1 + SLACK))
        measure(np.flatnonzero(open_), g)
    return entry, best, b, done


def packed(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(a.tobytes())])


def unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, *shape)


def assigned(state: DataFrame, history: list[list[np.ndarray]], width: int, first: bool) -> DataFrame:
    """The rows with their nearest entries by the last codebooks; ``history`` has, by part, the codebook of every round so far."""
    parts, w = len(history), history[0][0].shape[1]
    groups = -(-len(history[0][0]) // GROUP)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = np.zeros((batch.num_rows, parts * w), np.int64)
            x[:, :width] = matrix(col["x"], width)
            code = None if first else unpacked(col["code"], np.uint8, parts).astype(np.int64)
            low = None if first else unpacked(col["low"], np.float32, parts, groups)
            stamp = None if first else unpacked(col["stamp"], np.uint8, parts, groups)
            got = [assign(x[:, p * w : (p + 1) * w], history[p], None if first else code[:, p], None if first else Bounds(low[:, p], stamp[:, p])) for p in range(parts)]
            error = sum(g[1].astype(object) if g[1].dtype == object else g[1] for g in got)
            yield pa.RecordBatch.from_arrays(
                [col["vec_id"], col["label"], col["x"], packed(np.stack([g[0] for g in got], axis=1).astype(np.uint8)), pa.array(error.tolist(), pa.int64()),
                 packed(np.stack([g[2].low for g in got], axis=1).reshape(-1, parts * groups)), packed(np.stack([g[2].stamp for g in got], axis=1).reshape(-1, parts * groups))],
                names=["vec_id", "label", "x", "code", "error", "low", "stamp"],
            )

    kinds = {c: state.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return state.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<bigint>, code binary, error bigint, low binary, stamp binary")


def means(state: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks whose entries are the floors of their parts' means; an entry without parts stays."""
    parts, (k, w) = len(books), books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * k, w), object), np.zeros(parts * k, np.int64)
        for batch in batches:
            x = np.zeros((batch.num_rows, parts * w), np.int64)
            x[:, :width] = matrix(batch.column(0), width)
            at = unpacked(batch.column(1), np.uint8, parts).astype(np.int64) + np.arange(parts) * k
            rows = x.reshape(-1, w)
            safe = int(np.abs(x).max(initial=0)) * len(rows) < 2**62
            part = np.zeros((parts * k, w), np.int64 if safe else object)
            np.add.at(part, at.ravel(), rows if safe else rows.astype(object))
            total += part
            count += np.bincount(at.ravel(), minlength=parts * k)
        used = np.flatnonzero(count)
        if len(used):
            flat = exact_array(total[used].ravel().tolist())
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * w, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), each], names=["at", "n", "s"])

    each = state.select("x", "code").mapInArrow(sums, f"at int, n bigint, s array<{EXACT}>")
    got = each.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).cast(EXACT).alias(f"s{j}") for j in range(w)]).collect()
    new = [b.copy() for b in books]
    for r in got:
        new[r["at"] // k][r["at"] % k] = [int(r[f"s{j}"]) // r["n"] for j in range(w)]
    return new


def digest(books: list[np.ndarray], width: int) -> str:
    """SHA-256 of all entries' components, by part, entry and position."""
    w = books[0].shape[1]
    real = [b[:, : max(0, min(w, width - p * w))] for p, b in enumerate(books)]
    return hashlib.sha256(",".join(str(int(v)) for b in real for v in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], int]:
    """(vec_id, label, x, code, error) of every vector as a written table, the codebooks, and the vectors' length.

    A codebook starts from the vectors with the smallest ids, null ids last and equal ids by their components; with
    fewer vectors than ``entries`` it is shorter. Vectors that are null or hold null or non-finite components, or
    components of 2^51 and more, go; so do those of another length than most have. Where the length isn't a multiple of
    ``parts``, the last part is filled up with zeros. Repeated rows count each time. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite(F.col("v"), MOST))
    width = common_length(rows, "v")
    rows = rows.where((F.size("v") == width) & (F.size("v") > 0)).select("vec_id", "label", integers(F.col("v")).alias("x"))
    seeds = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not seeds:
        empty = rows.select("*", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, [np.zeros((0, 0), np.int64)] * parts, width
    w = -(-width // parts)
    first = np.zeros((len(seeds), parts * w), np.int64)
    first[:, :width] = [r["x"] for r in seeds]
    history = [[first[:, p * w : (p + 1) * w].copy()] for p in range(parts)]
    state = written(assigned(rows, history, width, True), "vector-codes")
    for _ in range(rounds):
        for h, new in zip(history, means(state, [h[-1] for h in history], width), strict=True):
            h.append(new)
        next_ = written(assigned(state, history, width, False), "vector-codes")
        drop_written(state)
        state = next_
    return state.select("vec_id", "label", "x", "code", "error"), [h[-1] for h in history], width


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector that :func:`compress` keeps: id, code in hex, error, the error of its label, and the codebooks' digest.

    Rows without label form one label. An empty table gives no rows.
    """
    state, books, width = compress(vectors, id_col, vector_col, label_col)
    by_label = written(state.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    # Both sides are written tables, so Spark knows their bytes, and broadcasts the labels' only where they are few.
    out = state.select("vec_id", "label", "code", "error").join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("vec_id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books, width)).alias("codebooks_sha256"))
