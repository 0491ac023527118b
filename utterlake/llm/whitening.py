"""Whitening of embeddings: exact cross-products from bit planes, then one small eigenproblem.

Entries become integers. A block of rows is shifted to start at 0 in each dimension, and each bit of each dimension is
packed across the rows into 64-bit words. The cross-product of two dimensions is then the sum over pairs of their bit
planes of 2^(i+j) times the number of ones in (plane i AND plane j). Blocks are added as integers without a bound, Spark
adds the tasks' sums as decimals, and the covariance is centred as n * sum(xy) - sum(x) * sum(y) before anything is
rounded. The driver sees d * (d + 3) / 2 + 1 numbers for d dimensions, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import EXACT, common_length, exact_array, finite, matrix

#: Fixed values of the contract: an entry c becomes floor(SCALE * c) + SHIFT; components that are returned.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows whose bit planes are held at once, and the variance, as a share of the largest, up to which a component is none.
BLOCK, NONE_BELOW = 8192, 1e-11
#: Entries from this size on have no long of their own.
MOST = 2.0**55


def integers(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c.astype(np.float64)).astype(np.int64) + SHIFT


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each dimension, sums of products of each two) of integer rows, as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    u = (x - low).astype(np.uint64)
    depth = [max(1, int(v).bit_length()) for v in u.max(axis=0)]
    padded = np.zeros((-(-n // 64) * 64, d), np.uint64)
    padded[:n] = u
    planes = [np.packbits((padded[:, a] >> np.uint64(i)).astype(np.uint8) & 1).view(np.uint64) for a in range(d) for i in range(depth[a])]
    p = np.stack(planes)
    ones = np.empty((len(p), len(p)), np.int64)
    for k in range(len(p)):
        ones[k, k:] = np.bitwise_count(p[k:] & p[k]).sum(axis=1, dtype=np.int64)
        ones[k:, k] = ones[k, k:]
    starts = np.concatenate([[0], np.cumsum(depth)[:-1]])
    kind = np.int64 if 2 * max(depth) + BLOCK.bit_length() < 62 else object
    weight = np.array([1 << i for k in depth for i in range(k)], dtype=kind)
    products = np.add.reduceat(np.add.reduceat(ones.astype(kind) * weight[:, None] * weight[None, :], starts, axis=0), starts, axis=1).astype(object)
    sums = np.add.reduceat(np.diag(ones).astype(kind) * weight, starts).astype(object)
    at = low.astype(object)
    return sums + n * at, products + np.outer(at, sums) + np.outer(sums, at) + n * np.outer(at, at)


@dataclass
class Whitening:
    """What the fit leaves: exact moments, and the components by falling variance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    variances: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def solve(n: int, sums: list[int], products: list[list[int]]) -> Whitening:
    d = len(sums)
    centred = [[n * products[a][b] - sums[a] * sums[b] for b in range(d)] for a in range(d)]
    v = np.array([[c / (n * n) for c in row] for row in centred], dtype=np.float64).reshape(d, d)
    e, q = np.linalg.eigh(v)
    keep = np.argsort(-e, kind="stable")
    keep = keep[e[keep] > NONE_BELOW * max(e.max(initial=0.0), 0.0)][:COMPONENTS]
    e, q = e[keep], q[:, keep]
    trace = sum(centred[a][a] for a in range(d)) / (n * n)
    w = q / np.sqrt(e)
    off = float(np.abs(w.T @ v @ w - np.eye(len(e))).max(initial=0.0))
    return Whitening(n, sums, v, e, q, e / trace if len(e) else e, off)


def fit(vectors: DataFrame, width: int) -> Whitening | None:
    """The whitening of a column ``v`` of finite vectors of one length; None without rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = integers(matrix(batch.column(0), width))
            for at in range(0, len(x), BLOCK):
                s, p = cross_products(x[at : at + BLOCK])
                sums, products = sums + s, products + p
            n += len(x)
        if n:
            a, b = np.triu_indices(width)
            i, j = np.concatenate([[-1], np.full(width, -1), a]), np.concatenate([[-1], np.arange(width), b])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), exact_array([n, *sums, *products[a, b]])], names=["i", "j", "value"])

    parts = vectors.select("v").mapInArrow(moments, f"i int, j int, value {EXACT}")
    got = {(r["i"], r["j"]): int(r["value"]) for r in parts.groupBy("i", "j").agg(F.sum("value").cast(EXACT).alias("value")).collect()}
    if not got:
        return None
    return solve(got[-1, -1], [got[-1, a] for a in range(width)], [[got[min(a, b), max(a, b)] for b in range(width)] for a in range(width)])


def kept(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that count, and their length."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v"), MOST))
    width = common_length(rows, "v")
    return rows.where(F.size("v") == width), width


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, y) of every vector, with y its whitened components by falling variance, and the fit's own columns.

    Vectors that are null or hold null or non-finite entries, or entries of 2^55 and more, go; so do those of another
    length than most have. Components whose variance is at most NONE_BELOW of the largest are none: equal vectors, or a
    single one, have an empty y. Repeated rows and ids count each time, a null id stays. Other columns are ignored; an
    empty table gives no rows. ``deviation`` is the exact sum over dimensions of (n * x - sum)^2.
    """
    rows, width = kept(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    f = fit(rows, width) if width else None
    if f is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, n long, deviation {EXACT}, y array<double>, explained array<double>, identity_error double")
    base = [s // f.n for s in f.sums]
    rest = [s - f.n * b for s, b in zip(f.sums, base, strict=True)]
    turn = f.components / np.sqrt(f.variances)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(matrix(batch.column(1), width)) - np.array(base, np.int64)
            y = (x - np.array([r / f.n for r in rest])) @ turn
            wide = f.n * (int(np.abs(x).max(initial=0)) + 1)
            t = x.astype(np.int64 if width * wide * wide < 2**63 else object) * f.n - np.array(rest, np.int64 if width * wide * wide < 2**63 else object)
            square = (t * t).sum(axis=1)
            deviation = pa.array(square).cast(pa.decimal128(38, 0)) if square.dtype == np.int64 else pa.array([Decimal(v) for v in square], pa.decimal128(38, 0))
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, parts], names=["vec_id", "deviation", "y"])

    out = rows.mapInArrow(projected, f"vec_id {kind}, deviation {EXACT}, y array<double>")
    return out.select(
        "vec_id", F.lit(f.n).cast("long").alias("n"), "deviation", "y",
        F.array(*[F.lit(float(x)) for x in f.explained]).cast("array<double>").alias("explained"), F.lit(f.identity_error).alias("identity_error"),
    )


def long_form(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    one = whitened.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("y").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
