"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned; each has a lookup table, learned by cyclic boosting: round by round each feature in turn gets a
shallow tree on its bins, fitted to the current gradient and added to its table at a small rate. Then the pairs with
the largest gain get tables of their own in the same way. Scoring adds up table entries, vectorised over rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_side, written
from .quality_rules import features

NAMES = ("words", "word_length", "symbols", "duplicate_lines", "repetition", "upper_case", "stops", "words_a_line")
#: Labelled rows that the fit may use at most, by a hash of the id; rounds, rate and bins of the boosting.
SAMPLE = 20_000
ROUNDS, RATE, BINS, PAIR_BINS, PAIRS = 200, 0.1, 32, 8, 4
THRESHOLD = 0.7


def inputs(f: Column) -> Column:
    """The features of a text as an array of doubles, in the order of NAMES; all zero without words."""
    n, chars = f["n_words"], f["word_chars"]
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return F.array(
        F.log1p(n.cast("double")), over(chars, n), over(f["n_symbols"], chars), over(f["lines"]["dup"], f["lines"]["all"]),
        over(f["n_repeat_words"], n), over(f["n_upper"], chars), over(f["n_stops"], n), F.log1p(over(n, f["lines"]["all"])),
    )


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def leaf(g: float | np.ndarray, h: float | np.ndarray) -> float | np.ndarray:
    return g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The leaf value of each bin, by the best cut of the bins and, below, the best cut of each side."""
    out = np.full(len(g), leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        k = int(np.argmax(gl**2 / (hl + 1) + gr**2 / (hr + 1))) + 1
        out = np.concatenate([tree(g[:k], h[:k], depth - 1), tree(g[k:], h[k:], depth - 1)])
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of log loss. Without both labels the score is their share; without rows 0.5."""
    share = (y.sum() + 1) / (len(y) + 2)
    m = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return m
    d = x.shape[1]
    m.edges = [cuts(x[:, j], BINS) for j in range(d)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    total = np.full(len(y), m.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = gradient()
            n = len(m.tables[j])
            step = RATE * tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            m.tables[j] += step
            total += step[bins[j]]
    m.pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(d)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.pair_edges)]
    g, h = gradient()

    def cells(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, shape[0] * shape[1]).reshape(shape)

    gain = {(a, b): float((cells(a, b, g) ** 2 / (cells(a, b, h) + 1)).sum()) for a, b in combinations(range(d), 2)}
    chosen = sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]
    m.pairs = [(a, b, np.zeros((len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1))) for a, b in chosen]
    for _ in range(ROUNDS // 4):
        for a, b, t in m.pairs:
            g, h = gradient()
            gc, hc = cells(a, b, g), cells(a, b, h)
            rows = tree(gc.sum(1), hc.sum(1), 1)  # one cut of a, then a cut of b on each side
            step = np.zeros_like(t)
            for v in np.unique(rows):
                side = rows == v
                step[side] = tree(gc[side].sum(0), hc[side].sum(0), 1)
            t += RATE * step
            total += RATE * step[coarse[a], coarse[b]]
    return m


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def training_rows(scored: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and labels of at most SAMPLE rows that aren't held out, by a hash of the id; what the driver sees is bounded by that."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    n = known.count()
    if n > SAMPLE:  # a few more at most, cut below
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < math.ceil(2**30 * SAMPLE / n))
    rows = scored.join(small_side(known, min(n, SAMPLE)), scored["doc_id"] == known["id"]).orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE).select("x", "y").collect()
    return np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score and predicted.

    Scores depend on the text alone. Null and empty texts are scored as texts without words. Without labels, or with
    one label only, every score is the share of good ones. A null id is not held out. Other columns are ignored; an
    empty table gives no rows.
    """
    x = written(docs.select(F.col(id_col).alias("doc_id"), let(features(F.col(text_col)), inputs).alias("x")), "additive-inputs")
    model = fit(*training_rows(x, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            s = model.score(flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = x.schema["doc_id"].dataType.simpleString()
    out = x.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "x").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("doc_id", id_col)
