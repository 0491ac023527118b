"""Near-duplicates by Jaccard similarity of word n-grams, with vertical partitioning.

The n-grams have one global order, rare ones first. It is cut into fragments, a document's n-grams into segments by
fragment; overlaps are counted for each fragment on its own and summed per pair. What is counted is kept small
without losing a link:

1. A document can only have a partner if enough of its first n-grams (by hash) occur in another document too. One
   pass over packed arrays of hashes finds these documents; all others are on their own.
2. Equal sets become one node.
3. Nodes that link share one of their rarest n-grams (prefix filter under the global order). Each node is compared
   with the best hub of its buckets, then, where a bucket still has several components, with the centre of the larger component. As
   Jaccard distance is a metric, a node that is farther from a centre than the component's radius plus the
   threshold distance links with none of its nodes; only the rest is compared node by node.

So groups of copies cost a comparison per copy, not per pair, and components are those of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .common import drop_written, settled, written
from .components import components

SHINGLE = 5
#: Similarity, in percent.
LEAST = 75
#: Share of a document's n-grams beyond the shortest prefix that the first pass looks at.
EXTRA = 0.1
#: Packed hashes per bucket of the first pass, on average; and how many a byte of text makes (a third of the words of six bytes).
PER_BUCKET = 1_000_000
HASHES_PER_BYTE = 0.06
#: Nodes of a frequent n-gram that one key of a join takes, as a power of two; more are dealt to several.
BLOCK = 9
#: Ids that may be broadcast; beyond, the join shuffles.
BROADCAST_IDS = 100_000


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-grams; of fewer words the whole sequence; none without words."""
    w = fp.words(texts, lower=True)
    g = fp.grams(w.hashes, SHINGLE)
    bounds = w.first.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a < SHINGLE:
            yield fp.grams(w.hashes[a:b], b - a, 8 * (b - a)) if b > a else w.hashes[:0]
            continue
        h = np.sort(g[a : b - SHINGLE + 1])
        new = np.ones(len(h), dtype=bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        yield h[new]


def least_overlap(n: int) -> int:
    return -(-LEAST * n // 100)


def prefix_length(n: int) -> int:
    return min(n, n - least_overlap(n) + 1 + int(EXTRA * n))


def needed(n: int) -> int:
    """How many of the prefix's n-grams must occur elsewhere: what the smallest possible partner's prefix guarantees."""
    return 1 + int(EXTRA * least_overlap(n))


def node_key(h: np.ndarray) -> int:
    """A hash of a set, as a signed long."""
    return int((fp.mix(h + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) ^ np.uint64(len(h) * 0x9E3779B97F4A7C15 & 2**64 - 1)).astype(np.int64))


#: Stands for a null id inside.
NO_ID = -(2**63)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, text): with a hash of the text, which tells rows of one id apart."""
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def sets(texts: DataFrame) -> DataFrame:
    """(doc_id, n, k, h): with the set itself."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in fp.parts(batches, 1):
            every = list(shingles(part.column(1)))
            n = np.array([len(h) for h in every], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            h = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(every).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array([node_key(x) for x in every], pa.int64()), h], names=["doc_id", "n", "k", "h"])

    return texts.select("doc_id", "text").mapInArrow(full, "doc_id long, n long, k long, h array<long>")


PACKED = "bucket int, hashes binary, keys binary, counts binary, doc_id long, t long, n long, k long"
#: The bucket of the rows (doc_id, t, n, k) of the documents themselves.
SIZES = -1
NAMES = ["bucket", "hashes", "keys", "counts", "doc_id", "t", "n", "k"]


def with_partners(texts: DataFrame, n_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n, k), with the size and the key of each document's set; and (k), the keys of sets enough of whose
    first n-grams occur twice or more.

    Each batch of rows sends its distinct prefix hashes, packed by hash range, with the key of the set that has
    them. An n-gram that the batch itself has twice is settled there and sent without a key, so a frequent one takes
    one entry per batch of rows, not one per document. Each set starts at minus what it needs. The number of ranges
    follows the bytes of all texts, so that a range stays near PER_BUCKET hashes.
    """
    buckets = max(32, math.ceil(n_bytes * HASHES_PER_BYTE / PER_BUCKET))
    bounds = np.arange(1, buckets, dtype=np.uint64) * np.uint64(2**64 // buckets)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every_key, total, prefixes = [], [], []
            for part in fp.parts([batch], 2):
                for h in shingles(part.column(2)):
                    every_key.append(node_key(h))
                    total.append(len(h))
                    prefixes.append(h[: prefix_length(len(h))].copy())
            empty = pa.nulls(len(total), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([SIZES] * len(total), pa.int32()), empty, empty, empty, batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(every_key, pa.int64())], names=NAMES)
            has = [i for i, n in enumerate(total) if n]
            if not has:
                continue
            keys = np.array(every_key, dtype=np.int64)[has]
            need = np.array([needed(total[i]) for i in has], dtype=np.int64)
            flat = np.concatenate([prefixes[i] for i in has])
            owner = np.repeat(np.arange(len(has), dtype=np.int32), [len(prefixes[i]) for i in has])
            del prefixes
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            del order
            new = np.ones(len(flat), dtype=bool)
            new[1:] = flat[1:] != flat[:-1]
            alone = new & np.append(new[1:], True)
            settled = np.bincount(owner[~alone], minlength=len(has))
            rows = [(int(keys[0]) % buckets, b"", keys.tobytes(), (settled - need).astype(np.int64).tobytes())]
            for kind, wanted in ((b"1", alone), (b"2", new & ~alone)):  # each n-gram once
                h, o = flat[wanted], owner[wanted]
                at = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                for b in range(buckets):
                    part = slice(at[b], at[b + 1])
                    if at[b] < at[b + 1]:
                        rows.append((b, h[part].tobytes(), keys[o[part]].tobytes() if kind == b"1" else b"", b""))
            cols = zip(*rows, strict=True)
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), none, none, none, none], names=NAMES)

    def counted(table: pa.Table) -> pa.Table:
        told = table.filter(pc.greater(pc.binary_length(table["counts"]), 0))
        keys, counts = [fp.numbers(told["keys"], np.int64)[0]], [fp.numbers(told["counts"], np.int64)[0]]
        sent = table.filter(pc.greater(pc.binary_length(table["hashes"]), 0)).select(["hashes", "keys"])
        h, n = fp.numbers(sent["hashes"], np.uint64)
        k, mine = fp.numbers(sent["keys"], np.int64)
        has = np.repeat(mine > 0, n)
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        again = np.zeros(len(h), dtype=bool)
        again[order] = ~(new & np.append(new[1:], True)) if len(h) else new  # known to more than one batch, or twice to one
        u, c = np.unique(k[again[has]], return_counts=True)
        return pa.table({"k": np.concatenate([*keys, u]), "c": np.concatenate([*counts, c.astype(np.int64)])})

    both = written(texts.mapInArrow(packed, PACKED), "jaccard-packed")
    sent = both.where(F.col("bucket") != SIZES).select("bucket", "hashes", "keys", "counts")
    counts = sent.groupBy("bucket").applyInArrow(counted, "k long, c long")
    size = written(both.where(F.col("bucket") == SIZES).select("doc_id", "t", "n", "k"), "jaccard-sizes")
    keys = written(counts.groupBy("k").agg(F.sum("c").alias("c")).where("c >= 0").select("k"), "jaccard-keys")
    drop_written(both)
    return size, keys


#: Columns of a node: its size and how many of its n-grams no other node has; the others in global order, rare first.
NODE = "k long, n long, alone long, mine array<struct<g:int,h:long>>"


def nodes(members: DataFrame) -> DataFrame:
    """Of each distinct set: the n-grams that another node has too, in global order, with their fragment.

    The order is by the power of two of the document frequency, then by hash. A fragment is a range of it, one power.
    """
    distinct = members.groupBy("k").agg(F.first("n").alias("n"), F.first("h").alias("h"))
    one = written(distinct, "jaccard-sets")
    flat = one.select("k", F.explode("h").alias("h"))
    shared = flat.groupBy("h").agg(F.count("*").alias("df")).where("df >= 2")
    octave = F.floor(F.log2("df")).cast("int").alias("g")
    placed = flat.join(shared.select("h", octave), "h").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("g", "h"))).alias("mine"))
    out = written(one.select("k", "n").join(placed, "k").select("k", "n", (F.col("n") - F.size("mine")).alias("alone"), "mine"), "jaccard-nodes")
    drop_written(one)
    return out


def linked(overlap: Column, a: Column, b: Column) -> Column:
    return 100 * overlap >= LEAST * (a + b - overlap)


def overlaps(pairs: DataFrame, node: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap): counted in each fragment on its own, and summed per pair.

    The shorter way round: segments of b travel with the pairs, those of a only once.
    """
    mine = segments.select(F.col("k").alias("b"), "g", F.col("hs").alias("hb"))
    theirs = segments.select(F.col("k").alias("a"), "g", F.col("hs").alias("ha"))
    part = pairs.select("a", "b").join(mine, "b").join(theirs, ["a", "g"]).select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("o"))
    total = part.groupBy("a", "b").agg(F.sum("o").alias("overlap"))
    n = node.select("k", "n")
    return total.join(n.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")


def possible(upper: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b n-grams, of which at most ``upper`` are common, can link; a is at least ``upper``."""
    return linked(upper, F.greatest(a, upper), b)


def labelled(bucketed: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return bucketed.withColumn("c", F.col("k"))
    return bucketed.join(labels.select(F.col("node").alias("k"), "label"), "k", "left").withColumn("c", F.coalesce("label", "k")).drop("label")


def salts(g: Column) -> Column:
    """Over how many keys the nodes of an n-gram are dealt, whose document frequency is below 2 ** (g + 1)."""
    return F.when(g < BLOCK, 1).otherwise(F.pow(F.lit(2.0), g + 1 - BLOCK)).cast("long")


def dealt(nodes_of: DataFrame, by: str) -> DataFrame:
    """With ``salt``, the part of its n-gram that a row belongs to, by a hash of the column ``by``."""
    return nodes_of.withColumn("salt", F.pmod(F.xxhash64(by), salts(F.col("g"))))


def repeated(per_gram: DataFrame) -> DataFrame:
    """A row for every part of its n-gram."""
    return per_gram.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts(F.col("g")) - 1))).drop("g")


def links(node: DataFrame) -> DataFrame:
    """(a, b): links enough that their components are those of all links.

    Pairs are left out only where a bound on their overlap rules a link out. From the first n-gram that two nodes share,
    both have ``rest`` n-grams left that others have as well; no more can be common. And where a centre c is known,
    what x and y share is inside c, at most the smaller of their overlaps with it, or outside, at most the smaller of
    what each has beyond c and its own.
    """
    short = F.col("n") - F.ceil(F.col("n") * LEAST / 100) + 1 - F.col("alone")
    near = node.withColumn("p", short.cast("int")).where("p > 0").select("k", "n", "alone", F.size("mine").alias("all"), F.posexplode(F.slice("mine", F.lit(1), F.col("p"))).alias("at", "x"))
    bucketed = written(near.select(F.col("x.h").alias("h"), F.col("x.g").alias("g"), "k", "n", "alone", (F.col("all") - F.col("at")).alias("rest")), "jaccard-prefix")
    segments = written(node.select("k", F.explode("mine").alias("x")).groupBy("k", "x.g").agg(F.collect_list("x.h").alias("hs")), "jaccard-segments")

    # A bucket's hub is the node with the smallest share of n-grams of its own; a node is compared with the best of its hubs.
    rank = F.struct((F.col("alone") / F.col("n")).alias("s"), F.col("k").alias("k"), F.col("n").alias("n"))
    hub = F.struct((F.col("alone") / F.col("n")).alias("s"), F.col("k").alias("k"), F.col("n").alias("n"), F.col("rest").alias("rest"))
    hubs = repeated(bucketed.groupBy("h").agg(F.min(hub).alias("hub"), F.max("g").alias("g"), F.count("*").alias("m")).where("m >= 2"))
    able = possible(F.least("rest", "hub.rest"), F.col("hub.n"), F.col("n"))
    best = dealt(bucketed, "k").join(hubs, ["h", "salt"]).where((F.col("k") != F.col("hub.k")) & able).groupBy("k").agg(F.min("hub").alias("hub"))
    stars = best.select(F.col("hub.k").alias("a"), F.col("k").alias("b"))
    tested = written(overlaps(stars, node, segments), "jaccard-tested")
    found = tested.where(linked(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")

    # Where a bucket still has several components, the nodes of the smaller are compared with the centre of the larger.
    labels = components(found)
    by = written(labelled(bucketed, labels), "jaccard-labelled")
    member = by.select("k", "n", "alone", "c").distinct()
    centre = member.groupBy("c").agg(F.min(rank)["k"].alias("centre"), F.count("*").alias("m"))
    comps = by.groupBy("h", "c").agg(F.max("rest").alias("most"), F.min("n").alias("least"), F.max("g").alias("g"))
    open_ = repeated(comps.groupBy("h").agg(F.count("*").alias("cs"), F.max("g").alias("g")).where("cs >= 2").select("h", "g"))
    mine = dealt(by, "k").join(open_, ["h", "salt"]).join(centre.select("c", "m"), "c").select("h", "salt", "k", "n", "alone", "rest", "c", "m")
    other = dealt(comps, "c").join(open_, ["h", "salt"]).join(centre, "c").select("h", "g", F.col("c").alias("oc"), F.col("centre").alias("a"), F.col("m").alias("om"), "most", "least")
    larger = (F.col("om") > F.col("m")) | ((F.col("om") == F.col("m")) & (F.col("oc") < F.col("c")))
    able = possible(F.least("rest", "most"), F.col("least"), F.col("n"))
    across = written(mine.join(repeated(other), ["h", "salt"]).where((F.col("c") != F.col("oc")) & larger & able).select("a", F.col("k").alias("b"), "n", "alone", "oc").distinct(), "jaccard-across")
    met = across.select(F.col("oc").alias("c")).distinct()
    inside = member.join(met, "c", "left_semi").join(centre, "c").where((F.col("k") != F.col("centre")) & (F.col("m") >= 2)).select(F.col("centre").alias("a"), F.col("k").alias("b"), "n", "alone")
    exact = written(overlaps(across.select("a", "b").union(inside.select("a", "b")).distinct(), node, segments), "jaccard-centres")
    more = exact.where(linked(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")

    # What a centre can't settle: nodes no farther from it than its component's radius and the threshold allow.
    away = 1 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))
    far = exact.select("a", "b", away.alias("d"), F.col("overlap").alias("o"))

    def placed(pairs: DataFrame) -> DataFrame:
        """With the distance d from the centre, the overlap o with it, and what is beyond it and others have, s."""
        o = F.coalesce("o", F.lit(0))
        return pairs.join(far, ["a", "b"], "left").withColumns({"d": F.coalesce("d", F.lit(1.0)), "s": F.col("n") - F.col("alone") - o, "o": o})

    around = written(placed(inside), "jaccard-around")
    radius = around.groupBy("a").agg(F.max("d").alias("r"), F.max("s").alias("ms"), F.min("n").alias("least"))
    limit = 1 - LEAST / 100 + 1e-9
    able = possible(F.col("o") + F.least("s", "ms"), F.col("least"), F.col("n"))
    unsettled = written(placed(across).join(radius, "a").where((F.col("d") > limit) & (F.col("d") <= limit + F.col("r")) & able).select("a", "b", "n", "d", "o", "s"), "jaccard-unsettled")
    where = by.select("h", "g", F.col("k").alias("b"), "rest")
    y = dealt(unsettled.join(where, "b"), "b").select("h", "salt", F.col("a").alias("centre"), "b", F.col("n").alias("nb"), F.col("d").alias("dy"), F.col("o").alias("oy"), F.col("s").alias("sy"), F.col("rest").alias("ry"))
    x = around.join(unsettled.select("a").distinct(), "a", "left_semi").join(where, "b")
    x = repeated(x).select("h", "salt", F.col("a").alias("centre"), F.col("b").alias("a"), F.col("n").alias("na"), F.col("d").alias("dx"), F.col("o").alias("ox"), F.col("s").alias("sx"), F.col("rest").alias("rx"))
    upper = F.least(F.least("ox", "oy") + F.least("sx", "sy"), "rx", "ry")
    able = possible(upper, F.col("na"), F.col("nb")) & (F.col("dy") - F.col("dx") <= limit)
    rest = y.join(x, ["h", "salt", "centre"]).where(able).select("a", "b").distinct()
    last = written(overlaps(rest, node, segments), "jaccard-rest")
    return found.union(more).union(last.where(linked(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b"))


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, n, c, component_id) of every row: c is one number per component, null without n-grams."""
    texts = _texts(docs, id_col, text_col)
    size, keys = with_partners(texts, docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    some = written(size.join(keys, "k").select("doc_id").distinct(), "jaccard-ids")
    ids = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
    node = nodes(sets(texts.join(ids, "doc_id", "left_semi")).where("n > 0"))
    least = size.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("first"))
    labels = settled(lambda: components(links(node)), "jaccard-labels")
    of = least.join(labels.select(F.col("node").alias("k"), "label"), "k", "left").select("k", "first", F.coalesce("label", "k").alias("c"))
    of = written(of, "jaccard-classes")
    for done in (keys, some, node, labels):
        drop_written(done)
    lowest = of.groupBy("c").agg(F.min("first").alias("component_id"))
    of = of.join(lowest, "c").select(F.struct("k", "c", "component_id").alias("of"))
    out = size.join(of, (F.col("k") == F.col("of.k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "t", "n", F.col("of.c").alias("c"), F.coalesce("of.component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the smallest id that links lead to.

    Null and empty texts and texts without words have no n-grams and link with nothing. Repeated rows link, as do
    rows of one id by their own texts. A null id counts as smaller than all others and stays null. Other columns are
    ignored; an empty table gives no rows.
    """
    none = F.lit(NO_ID)
    return classified(docs, id_col, text_col).select(F.nullif("doc_id", none).alias(id_col), F.col("n").alias("n_shingles"), F.nullif("component_id", none).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, that of the smallest id.

    Of rows with one id the one with the smallest hash of its text, and of repeated rows one. Rows without n-grams
    (null, empty and wordless texts) all stay. A null id counts as smaller than all others. Other columns go along,
    whatever their names; an empty table gives no rows.
    """
    c = written(classified(docs, id_col, text_col), "jaccard-components")
    alone = c.where("n = 0").select("doc_id", "t", F.lit(True).alias("all")).distinct()
    row = F.struct("doc_id", "t")
    firsts = c.where("n > 0").groupBy("c").agg(F.min(row).alias("r"))
    copies = c.where("n > 0").groupBy("doc_id", "t").agg(F.count("*").alias("rows"))
    kept = firsts.select("r.*").join(copies, ["doc_id", "t"]).select("doc_id", "t", (F.col("rows") == 1).alias("all"))
    keep = written(alone.union(kept), "jaccard-kept")
    drop_written(c)
    here = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col("__keep.doc_id")) & (F.xxhash64(F.col(text_col)) == F.col("__keep.t"))
    stay = lambda which: docs.join(keep.where(which).select(F.struct("doc_id", "t").alias("__keep")), here, "left_semi")
    if keep.where("not all").limit(1).count():  # repeated rows: one stays
        return stay("all").union(stay("not all").dropDuplicates([id_col, text_col]))
    return stay("all")
