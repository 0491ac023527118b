"""Masked pseudo-likelihood: a bidirectional window network scores every token of a text from both its sides.

A token is a word. Words are in one of CLASSES classes by their form: short ones by themselves, others by their last two
bytes and whether they begin with a capital. The network predicts a masked token's class from the classes of the two
tokens on either side; within a class a word has its share of the class's tokens in all documents. So every word has
its own probability, and those of all words add up to 1. A document's score is the sum over all its tokens.

Words are counted as packed hashes. Each part of the input sends its distinct hashes and how often it has them to
buckets by hash range and gets the logarithms of the corpus counts back, in the same order; what a part sends for a
word doesn't grow with how often it has it. The network is trained from the class numbers, one byte a token: documents
are dealt by a hash into shards of about SHARD tokens, however the input is partitioned; in each of ROUNDS rounds every
shard trains on its own from the same weights, on one of ROUNDS disjoint shares of the positions, and the weights
are averaged. So every position is a target once, and more data are more shards, not less of a step for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .common import drop_written, written

CLASSES = 256
#: Beyond the classes: the edge of a text.
EDGE = CLASSES
VECTOR, HIDDEN, REACH = 8, 16, (-2, -1, 1, 2)
#: Rounds of training, each on its share of all positions; tokens of a shard; positions per step; rate (Adagrad).
ROUNDS, SHARD, STEP, RATE = 3, 1 << 21, 512, 0.1
#: Bytes of text in a part; tokens per bucket of the counts, and how many a byte of text makes; tokens scored at a time.
PART, PER_BUCKET, WORDS_PER_BYTE, AT_ONCE = 1 << 23, 4_000_000, 0.17, 1024
SHAPES = {"e": (EDGE + 1, VECTOR), "w": (VECTOR * len(REACH), HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "d": (CLASSES,)}
#: Logarithms of counts are whole numbers of this unit, as their sums are the same in any order.
UNIT = 1e-6


# ---- the network


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(counts: np.ndarray) -> np.ndarray:
    """Weights that predict the classes' shares whatever is around."""
    r = np.random.default_rng(7)
    p = {k: r.normal(0, 0.2, s) for k, s in SHAPES.items()}
    p["b"][:] = 0
    p["c"] *= 0
    p["d"] = np.log((counts + 0.5) / (counts + 0.5).sum())
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def hidden(p: dict, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = p["e"][around].reshape(len(around), -1)
    return x, np.tanh(x @ p["w"] + p["b"])


def log_probs(p: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    z = hidden(p, around)[1] @ p["c"] + p["d"]
    z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(target)), target]
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1, dtype=np.float64))


def gradient(p: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability, in the order of SHAPES."""
    n = len(target)
    x, h = hidden(p, around)
    dz = softmax(h @ p["c"] + p["d"])
    dz[np.arange(n), target] -= 1
    dz /= n
    da = (dz @ p["c"].T) * (1 - h * h)
    dx = (da @ p["w"].T).reshape(-1, VECTOR)
    flat = around.ravel()
    de = np.stack([np.bincount(flat, dx[:, v], EDGE + 1) for v in range(VECTOR)], axis=1)
    return np.concatenate([de.ravel(), (x.T @ da).ravel(), da.sum(0), (h.T @ dz).ravel(), dz.sum(0)])


def runs(texts: list[bytes], most: int = 100_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, classes with edges between texts, owner of each or -1), of about ``most`` tokens."""
    edge = np.full(2, EDGE, np.int16)
    parts, owner, n, first = [edge], [np.full(2, -1)], 0, 0
    for i, t in enumerate(texts):
        x = np.frombuffer(t, dtype=np.uint8).astype(np.int16)
        parts += [x, edge]
        owner += [np.full(len(x), i - first), np.full(2, -1)]
        n += len(x)
        if n >= most or i == len(texts) - 1:
            yield first, np.concatenate(parts), np.concatenate(owner)
            parts, owner, n, first = [edge], [np.full(2, -1)], 0, i + 1


def masked(tokens: np.ndarray, owner: np.ndarray, turn: int) -> np.ndarray:
    """The positions that training predicts in round ``turn``: by a hash of the place and the token before, so reruns agree."""
    at = np.flatnonzero(owner >= 0)
    h = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tokens[at - 1].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    return at[h * np.uint64(ROUNDS) >> np.uint64(24) == turn]


def learn(flat: np.ndarray, texts: list[bytes], turn: int, power: np.ndarray) -> int:
    """Steps over the positions of ``turn``, in place; ``power`` gathers the squares of gradients. Returns how many positions."""
    p, reach, seen = unpack(flat), np.array(REACH), 0
    for _, x, owner in runs(texts):
        at = masked(x, owner, turn)
        seen += len(at)
        for k in range(0, len(at), STEP):
            part = at[k : k + STEP]
            g = gradient(p, x[part[:, None] + reach], x[part])
            power += g * g
            flat -= (RATE * g / np.sqrt(power)).astype(np.float32)
    return seen


def scores(p: dict, texts: list[bytes], log_counts: np.ndarray) -> np.ndarray:
    """Per text the summed log-probability of its tokens' classes, less the logarithms of the classes' counts."""
    total, reach = np.zeros(len(texts)), np.array(REACH)
    for first, x, owner in runs(texts):
        at = np.flatnonzero(owner >= 0)
        for k in range(0, len(at), AT_ONCE):
            part = at[k : k + AT_ONCE]
            lp = log_probs(p, x[part[:, None] + reach], x[part]) - log_counts[x[part]]
            total += np.bincount(owner[part] + first, lp, len(texts))
    return total


# ---- words and their counts


def classes(w: fp.Words) -> np.ndarray:
    """The class of each word, from its bytes."""
    size, last = w.end - w.begin, w.end - 1
    b = [w.data[np.maximum(last - k, w.begin)].astype(np.uint64) for k in range(3)]
    first = w.data[w.begin]
    key = b[0] | b[1] << np.uint64(8)
    short = size <= 3
    key |= np.where(short, b[2] << np.uint64(16) | (size.astype(np.uint64) << np.uint64(32)), ((first >= 65) & (first <= 90)).astype(np.uint64) << np.uint64(40))
    return (fp.mix(key + np.uint64(1)) >> np.uint64(56)).astype(np.uint8)


#: What a row of the packed table is, if not a bucket of words: a document; the counts of its part's classes.
DOCUMENT, COUNTS = -1, -2


def binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of a binary column that lie one after another in ``values``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def packed(docs: DataFrame, n_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """(bucket, at, i, id, n, classes, hashes, reps, rows), written: of each part its documents, the counts of its classes,
    and by bucket its distinct word hashes, how often each occurs and, in turn, in which documents of the part."""
    buckets = max(16, math.ceil(n_bytes * WORDS_PER_BYTE / PER_BUCKET))
    bounds = np.arange(1, buckets, dtype=np.uint64) * np.uint64(2**64 // buckets)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["bucket", "at", "i", "id", "n", "classes", "hashes", "reps", "rows"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() << 32) - 1
        for part in fp.parts(batches, 1, PART):
            at += 1
            w = fp.words(part.column(1))
            c, n, rows = classes(w), np.diff(w.first), part.num_rows
            empty = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, DOCUMENT, np.int32)), pa.array(np.full(rows, at)), pa.array(np.arange(rows, dtype=np.int32)), part.column(0), pa.array(n), binary(c, n), empty, empty, empty], names=names)
            order = np.argsort(w.hashes, kind="stable")
            h, owner = w.hashes[order], np.repeat(np.arange(rows, dtype=np.uint32), n)[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            begin = np.flatnonzero(new)
            h, reps = h[begin], np.diff(np.append(begin, len(h))).astype(np.uint32)
            edge = np.array([0, *np.searchsorted(h, bounds), len(h)])
            per, token = np.diff(edge), np.diff(np.append(begin, len(owner))[edge])
            b = len(per) + 1
            tally = binary(np.bincount(c, minlength=CLASSES).astype(np.int64), np.array([CLASSES]))
            cols = [pa.concat_arrays([tally, binary(h, per)]), pa.concat_arrays([pa.nulls(1, pa.binary()), binary(reps, per)]), pa.concat_arrays([pa.nulls(1, pa.binary()), binary(owner, token)])]
            yield pa.RecordBatch.from_arrays([pa.array([COUNTS, *range(b - 1)], pa.int32()), pa.array(np.full(b, at)), pa.nulls(b, pa.int32()), pa.nulls(b, part.column(0).type), pa.nulls(b, pa.int64()), pa.nulls(b, pa.binary()), *cols], names=names)

    schema = f"bucket int, at long, i int, id {kind}, n long, classes binary, hashes binary, reps binary, rows binary"
    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema), "lm-packed")


def class_counts(table: DataFrame) -> np.ndarray:
    """How many tokens of all documents each class has."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(total)], names=["c", "n"])

    out = np.zeros(CLASSES)
    for r in table.where(F.col("bucket") == COUNTS).select("hashes").mapInArrow(told, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # a row for each class
        out[r["c"]] = r["n"]
    return out


def word_logs(table: DataFrame) -> DataFrame:
    """(at, bucket, logs): the logarithm of each hash's count in all documents, in the order in which the part has them."""

    def counted(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        h, n = fp.numbers(t["hashes"], np.uint64)
        r, _ = fp.numbers(t["reps"], np.uint32)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        of = np.cumsum(new) - 1
        logs = np.empty(len(h), dtype=np.int32)
        logs[order] = np.rint(np.log(np.bincount(of, r[order], 1)) / UNIT)[of]
        return pa.table({"at": t["at"], "bucket": t["bucket"], "logs": binary(logs, n)})

    words = table.where("bucket >= 0").select("bucket", "at", "hashes", "reps")
    return words.groupBy("bucket").applyInArrow(counted, "at long, bucket int, logs binary")


# ---- training and scoring


def train(table: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The network's weights after all rounds over the documents of :func:`packed`."""
    weights = start(counts).astype(np.float64)
    shards = max(1, math.ceil(counts.sum() / SHARD))
    h = F.xxhash64("id", "classes")  # copies have ids of their own, so they are dealt to all shards
    tokens = table.where((F.col("bucket") == DOCUMENT) & (F.col("n") > 0)).select(F.pmod(h, F.lit(shards)).alias("shard"), h.alias("h"), "classes")
    tokens = written(tokens.repartition(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "classes"), "lm-shards")
    groups = math.ceil(math.sqrt(shards))

    for turn in range(ROUNDS):
        now = weights.astype(np.float32)

        def local(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, turn: int = turn) -> Iterator[pa.RecordBatch]:
            shard, flat, power, seen = None, now.copy(), np.full(len(now), 1e-6), 0

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard % groups]), pa.array([shard]), pa.array([float(seen)]), pa.array([(flat.astype(np.float64) * seen).tobytes()], pa.binary())], names=["g", "shard", "n", "v"])

            for batch in batches:
                of = batch.column(0).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip(cut, cut[1:]):
                    if b > a and of[a] != shard:
                        if shard is not None:
                            yield told()
                        shard, flat, power, seen = int(of[a]), now.copy(), np.full(len(now), 1e-6), 0
                    seen += learn(flat, batch.column(1).slice(a, b - a).to_pylist(), turn, power)
            if shard is not None:
                yield told()

        def added(t: pa.Table) -> pa.Table:
            t = t.sort_by([("shard", "ascending"), ("n", "ascending")])
            v = sum((np.frombuffer(x.as_py(), np.float64) for x in t["v"]), np.zeros(len(weights)))
            return pa.table({"n": [pc.sum(t["n"]).as_py()], "v": pa.array([v.tobytes()], pa.binary())})

        # Weights of all shards are added up in groups; as many rows as there are groups come to the driver.
        sums = tokens.mapInArrow(local, "g long, shard long, n double, v binary").groupBy("g").applyInArrow(added, "n double, v binary").collect()
        n = math.fsum(r["n"] for r in sums)
        if n:
            weights = sum(np.frombuffer(r["v"], np.float64) for r in sorted(sums, key=lambda r: bytes(r["v"]))) / n
    drop_written(tokens)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, log_prob (natural, summed) and perplexity.

    Null and empty texts have no tokens: log_prob 0, perplexity null. Equal texts get equal scores, repeated rows
    included. Other columns are ignored, whatever their names; an empty table gives no rows. Scores don't depend on how
    the rows are partitioned, but for rounding.
    """
    table = packed(docs, docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0, id_col, text_col)
    counts = class_counts(table)
    weights = train(table, counts)
    logs = written(word_logs(table), "lm-logs")
    log_counts = np.log(np.maximum(counts, 1))
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        here = left.filter(pc.equal(left["bucket"], DOCUMENT))
        words = left.filter(pc.greater_equal(left["bucket"], 0)).sort_by("bucket")
        value, _ = fp.numbers(right.sort_by("bucket")["logs"], np.int32)
        reps, _ = fp.numbers(words["reps"], np.uint32)
        rows, _ = fp.numbers(words["rows"], np.uint32)
        here = here.sort_by("i")
        outer = np.bincount(rows, np.repeat(value, reps), here.num_rows) * UNIT
        total = np.round(scores(unpack(weights.astype(np.float32)), here["classes"].to_pylist(), log_counts) + outer, 4)
        return pa.table({"id": here["id"], "n_tokens": here["n"], "log_prob": total + 0.0})

    left = table.where(F.col("bucket") != COUNTS).select("bucket", "at", "i", "id", "n", "classes", "reps", "rows")
    both = left.groupBy("at").cogroup(logs.groupBy("at")).applyInArrow(scored, f"id {kind}, n_tokens long, log_prob double")
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(F.least(F.lit(700.0), -F.col("log_prob") / F.col("n_tokens"))))
    return both.withColumn("perplexity", perplexity).withColumnRenamed("id", id_col)
