"""Removal of passages that repeat, over a log-structured index of fingerprints.

A window is WINDOW consecutive words. Of the GRAM-word hashes inside a window the smallest is its anchor, so equal
windows have equal anchors, and neighbouring windows mostly share theirs: one fingerprint in about fourteen words
stands for all windows. The index is a list of immutable runs sorted by fingerprint, each with the count and one
place of every fingerprint; a batch of documents is merge-joined with the runs and becomes a run itself, and runs are
compacted into one when there are too many. A fingerprint that its batch has twice, or that a later batch finds in an
older run, is in several places; windows of the other anchors can't repeat. Those of the former are verified by a hash
of the whole window, with the words as they are, beside the windows of older documents, which are read again for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .common import drop_written, written

WINDOW, GRAM = 35, 8
INSIDE = WINDOW - GRAM + 1
#: Batches in which a whole table enters the index, and runs beyond which the index is compacted.
BATCHES, MOST_RUNS = 6, 4


#: Low bits of a value that hold its place while the smallest is looked for; the others are the fingerprint's.
PLACE = 28


def smallest(g: np.ndarray) -> np.ndarray:
    """The place of the smallest of each INSIDE values in a row, the first of equal ones: minima over twice the width, again and again."""
    low = np.uint64(2**PLACE - 1)
    v = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    wide = 1
    while 2 * wide <= INSIDE:
        v = np.minimum(v[:-wide], v[wide:])
        wide *= 2
    return (np.minimum(v[: len(v) - (INSIDE - wide)], v[INSIDE - wide :]) & low).astype(np.int64)


def marks(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: its bytes from the first word to the last, its fingerprints, the places of the distinct anchors, and the place of each window's anchor."""
    w = fp.words(texts)
    g = fp.grams(w.hashes, GRAM)
    of = smallest(g) if len(g) >= INSIDE else np.empty(0, np.int64)
    bounds = w.first.tolist()
    for a, b in zip(bounds, bounds[1:]):
        raw = w.data[w.begin[a] : w.end[b - 1]].tobytes() if b > a else b""
        mine = of[a : b - WINDOW + 1] - a if b - a >= WINDOW else of[:0]
        new = np.ones(len(mine), dtype=bool)
        np.not_equal(mine[1:], mine[:-1], out=new[1:])  # places only rise
        yield raw, g[a : max(a, b - GRAM + 1)], mine[new], mine


def window_hashes(g: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each window: its fingerprints at 0, 8, 16, 24 and 27 cover all its words."""
    a = np.zeros(len(starts), dtype=np.uint64)
    b = np.zeros(len(starts), dtype=np.uint64)
    for k, at in enumerate((0, 8, 16, 24, INSIDE - 1)):
        x = g[starts + at]
        a += x * fp.MULTIPLIERS[40 + k]
        b += fp.mix(x + fp.MULTIPLIERS[50 + k]) * fp.MULTIPLIERS[30 + k]
    return fp.mix(a), fp.mix(b) >> np.uint64(32)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text). Rows of equal id and text share a key and are told apart by their count alone."""
    t = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), t).alias("key"), t.alias("text"))


def marked(texts: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, sha, h, pos): the digest of all words, and the fingerprint and place of every anchor."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fp.parts(batches, 2):
            n, s, h, p, sizes = [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [0]
            for raw, g, at, _ in marks(part.column(2)):
                w = raw.split()
                n.append(len(w))
                s.append(hashlib.sha256(b" ".join(w)).hexdigest())
                h.append(g[at])
                p.append(at)
                sizes.append(len(at))
            offsets = pa.array(np.cumsum(sizes), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).view(np.int64))) for x in (h, p)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(s, pa.string()), *lists], names=["doc_id", "key", "n_words", "sha", "h", "pos"])

    return texts.mapInArrow(found, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, key long, n_words long, sha string, h array<long>, pos array<long>")


def fingerprint_rows(of: DataFrame) -> DataFrame:
    """(h, key, pos) of every anchor of :func:`marked` texts."""
    return of.select("key", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("x.h", "key", F.col("x.pos").cast("int").alias("pos"))


class FingerprintIndex:
    """Immutable runs (h, n, key, pos), each sorted by h; n places in all, of which (key, pos) is one.

    ``texts`` are the tables that were added; their documents are read again where a later window may repeat there.
    """

    def __init__(self, most_runs: int = MOST_RUNS) -> None:
        self.runs: list[DataFrame] = []
        self.retired: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.most_runs = most_runs

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        # If n is 1, the least key and the least pos are those of the one place.
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("pos").alias("pos"))

    def add(self, texts: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """Index a batch; returns its run with ``seen``: whether an older run has the fingerprint. ``of``: its :func:`marked` texts, if there."""
        rows = self._summed(fingerprint_rows(marked(texts) if of is None else of).withColumn("n", F.lit(1).cast("long")))
        run = written(rows.sortWithinPartitions("h"), "fingerprint-run")
        old = self.merged()
        self.runs.append(run)
        self.texts.append(texts.select("key", "text"))
        if len(self.runs) > self.most_runs:
            self.compact()
        if old is None:
            return run.withColumn("seen", F.lit(False))
        return run.join(old.select("h", F.lit(True).alias("old")).hint("merge"), "h", "left").withColumn("seen", F.coalesce("old", F.lit(False))).drop("old")

    def merged(self) -> DataFrame | None:
        if len(self.runs) < 2:
            return self.runs[0] if self.runs else None
        every = self.runs[0]
        for r in self.runs[1:]:
            every = every.unionByName(r)
        return self._summed(every)

    def compact(self) -> None:
        if len(self.runs) > 1:
            one = written(self.merged().sortWithinPartitions("h"), "fingerprint-run")
            self.retired += self.runs  # what was derived from them may still be read
            self.runs = [one]

    def vacuum(self) -> None:
        """Delete the runs that compaction has replaced."""
        for r in self.retired:
            drop_written(r)
        self.retired = []


def open_windows(of: np.ndarray, at: np.ndarray, single: list[int] | None) -> np.ndarray:
    """Starts of the windows whose anchor is in more than one place."""
    lone = np.isin(at, np.array(single or [], dtype=np.int64))
    return np.flatnonzero(np.isin(of, at[~lone]))


def older_texts(texts: list[DataFrame], hits: DataFrame) -> DataFrame | None:
    """(key, text, single) of the older documents that have one of the fingerprints ``hits``; all their other anchors are ``single``."""
    if not texts:
        return None
    every = texts[0]
    for t in texts[1:]:
        every = every.unionByName(t)
    every = every.select(F.lit(0).alias("doc_id"), "key", "text")
    found = fingerprint_rows(marked(every)).join(hits.select("h", F.lit(True).alias("hit")), "h", "left")
    by = found.groupBy("key").agg(F.count("hit").alias("hits"), F.collect_list(F.when(F.col("hit").isNull(), F.col("pos"))).alias("single"))
    return every.join(by.where("hits > 0").select("key", "single"), "key")


def repeats(texts: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """(key, single_windows): of the rows of (key, text, single), the starts of the open windows that are found once only, there and in ``older``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fp.parts(batches, 1):
            cols: list[list] = [[np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]]
            keys, singles = part.column(0).to_pylist(), part.column(2).to_pylist()
            for key, single, (_, g, at, of) in zip(keys, singles, marks(part.column(1)), strict=True):
                starts = open_windows(of, at, single)
                a, b = window_hashes(g, starts)
                for c, x in zip(cols, (a.view(np.int64), b.astype(np.uint32).view(np.int32), np.full(len(starts), key, np.int64), starts.astype(np.int32)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["a", "b", "key", "start"])

    both = texts.select("key", "text", "single")
    if older is not None:
        both = both.unionByName(older.select("key", "text", "single"))
    rows = both.mapInArrow(hashed, "a long, b int, key long, start int")
    once = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("start").alias("start")).where("n = 1")
    return once.groupBy("key").agg(F.collect_list("start").alias("single_windows"))


def left(n: int, of: np.ndarray, at: np.ndarray, single: list[int] | None, single_windows: list[int] | None) -> np.ndarray:
    """Which of ``n`` words no repeated window covers."""
    starts = np.setdiff1d(open_windows(of, at, single), np.array(single_windows or [], dtype=np.int64), assume_unique=True)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) == 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed and kept_sha256, the digest of the words that are left.

    Null and empty texts have no words; texts shorter than a window keep all. Of repeated rows all lose what repeats.
    Other columns are ignored; an empty table gives no rows. With an ``index`` of older documents, theirs count as
    places too.
    """
    texts = keyed(docs, id_col, text_col)
    own = index is None
    index = index or FingerprintIndex()
    before, runs = list(index.texts), []
    every = written(marked(texts), "dedup-marked")
    fresh, hits = None, None
    for b in range(BATCHES):
        mine = F.pmod("key", F.lit(BATCHES)) == b
        run = written(index.add(texts.where(mine), every.where(mine)).where("seen or n = 1"), "dedup-run")
        runs.append(run)
        one, old = run.where("n = 1 and not seen").select("h", "key", "pos"), run.where("seen").select("h")
        fresh, hits = (one, old) if fresh is None else (fresh.unionByName(one), hits.unionByName(old))
    hits = hits.distinct()
    # What is new to its batch's elder runs can only be found again by a later batch.
    unique = fresh.join(hits.hint("merge"), "h", "left_anti").groupBy("key").agg(F.collect_list("pos").alias("single"))
    unique = written(unique, "dedup-unique")
    if own:
        index.vacuum()
    if not before:  # all that is needed of the runs is in ``unique``; they go before the texts are dealt
        for old in runs + (index.runs if own else []):
            drop_written(old)
    some = every.join(unique.select("key", F.size("single").alias("u")), "key", "left").where(F.size("h") > F.coalesce("u", F.lit(0)))
    some = written(some.select("key").distinct(), "dedup-open")
    touched = written(texts.join(some.hint("merge"), "key", "left_semi").join(unique, "key", "left"), "dedup-texts")
    once = repeats(touched, older_texts(before, hits))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fp.parts(batches, 1):
            n, r, s = [], [], []
            for single, windows, (raw, _, at, of) in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), marks(part.column(1)), strict=True):
                w = raw.split()
                stay = left(len(w), of, at, single, windows)
                n.append(len(w))
                r.append(len(w) - int(stay.sum()))
                s.append(hashlib.sha256(b" ".join(compress(w, stay.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    done = touched.join(once, "key", "left").select("doc_id", "text", "single", "single_windows").mapInArrow(finished, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    whole = every.join(some, "key", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return whole.unionByName(done).withColumnRenamed("doc_id", id_col)
