"""Phrase search over a table of trigrams, ranked by BM25; and how much of a term list hypotheses keep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.edits import char_codes
from . import keywords
from .keywords import windows

#: Folders of a written index; a trigram lies in one of them, its texts in any number of files there.
FOLDERS = 256
#: Files that a folder's most frequent trigrams are dealt to.
DEALS = 8
#: Characters of texts whose postings are listed together.
LISTED = 1 << 21


def spotted(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str) -> DataFrame:
    """(id, term): terms that occur in a text as substrings, case aside, by one pass over each text."""
    return keywords.occurring(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", terms, term_col)


def trigrams(c: Column) -> Column:
    """Distinct trigrams in lower case."""
    return F.array_distinct(windows(F.lower(c), 3))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, id). Texts of under three characters have none."""
    return docs.select(F.explode(trigrams(F.col(text_col))).alias("gram"), F.col(id_col).alias("id"))


def gram_lists(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(trigrams, where the list of each begins and the last ends, numbers of the texts in each list) of texts by code points and ends, in one sort.

    A trigram and its text's number are one integer; texts too many for that are halved, and one alone always fits.
    """
    n = len(ends) - 1
    wide, deep = int(codes[ends[0] : ends[-1]].max(initial=0)).bit_length(), (n - 1).bit_length()
    if 3 * wide + deep > 63:
        for first, part in ((0, ends[: n // 2 + 1]), (n // 2, ends[n // 2 :])):
            for grams, offsets, rows in gram_lists(codes, part):
                yield grams, offsets, rows + first
        return
    c = codes[ends[0] : ends[-1]].astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(ends))
    whole = np.flatnonzero(text[2:] == text[:-2])
    keys = ((c[whole] << wide | c[whole + 1]) << wide | c[whole + 2]) << deep | text[whole]
    keys.sort()
    keys = keys[np.diff(keys, prepend=-1) != 0]
    offsets = np.flatnonzero(np.diff(keys >> deep, prepend=-1))
    grams = keys[offsets] >> deep
    spelt = np.stack([grams >> 2 * wide, grams >> wide, grams], axis=1) & ((1 << wide) - 1)
    spelt = spelt.astype("<u4").tobytes().decode("utf-32-le")
    yield [spelt[i : i + 3] for i in range(0, len(spelt), 3)], np.append(offsets, len(keys)), keys & ((1 << deep) - 1)


def posting_lists(docs: DataFrame, id_col: str, text_col: str, most: int = LISTED) -> DataFrame:
    """(gram, ids): :func:`postings` as lists, one for each trigram of some neighbouring texts; ids are long and not null."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = char_codes(batch.column(1))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
                for grams, offsets, rows in gram_lists(codes, ends[first : last + 1]):
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), batch.column(0).take(pa.array(first + rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), ids], names=["gram", "ids"])
                first = last

    return docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col)).mapInArrow(listed, "gram string, ids array<long>")


def folder(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


def write_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Postings in folders by trigram, sorted by it within files, so that a search reads few row groups of few folders."""
    p = postings(docs, id_col, text_col).withColumn("folder", folder(F.col("gram"))).repartition("folder", F.pmod(F.xxhash64("id"), F.lit(DEALS)))
    p.sortWithinPartitions("folder", "gram", "id").write.mode("overwrite").partitionBy("folder").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def phrase_search(index: DataFrame | None, docs: DataFrame, id_col: str, text_col: str, phrase: str, limit: int = 50, sizes: DataFrame | None = None) -> DataFrame:
    """(id, score) of the best texts with ``phrase``, case aside: BM25 (k1 1.2, b 0.75) over the phrase's count, ties by id.

    ``index`` is a table of ``postings`` or None. Texts that have all trigrams of the phrase are looked at; phrases of
    under three characters have no trigrams and are looked for everywhere. Overlapping finds count once. ``sizes`` (mean,
    docs) is one row on all texts, if it is known; else the texts are read for it.
    """
    p = phrase.lower()
    d = docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("n"), F.col(text_col).alias("t"))
    hits = d
    if index is not None and len(p) >= 3:
        grams = sorted({p[i : i + 3] for i in range(len(p) - 2)})
        i = index.where(F.col("gram").isin(grams))
        if "folder" in index.columns:
            i = i.where(F.col("folder").isin(*[int(r[0]) for r in index.sparkSession.createDataFrame([(g,) for g in grams], "g string").select(folder(F.col("g"))).collect()]))
        hits = d.join(i.groupBy("id").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(grams)), "id", "left_semi")
    hits = hits.withColumn("t", F.lower("t")).where(F.contains("t", F.lit(p))).select("id", "n", ((F.length("t") - F.length(F.replace("t", F.lit(p), F.lit("")))) / len(p)).alias("tf"))
    sizes = d.agg(F.avg("n").alias("mean"), F.count("n").alias("docs")) if sizes is None else sizes
    s = sizes.crossJoin(hits.agg(F.count("*").alias("df"))).select("mean", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    score = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    return hits.crossJoin(s).select("id", F.round(score, 5).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def coverage(pairs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, engine, ps_total, ps_hits, ps_rate, ki_total, ki_hits, ki_rate, difference, ki_misses) of (id, engine, ref, hyp).

    Of the phrases and of the key terms that a reference has, how many its hypotheses keep; a rate of nothing is 0.
    ``phrases`` (phrase) go to every task when small, else they are joined. Ids are references' keys.
    """
    said = F.collect_list(F.struct("engine", "hyp")).alias("hyps")
    return covered(pairs.groupBy("id").agg(F.first("ref").alias("ref"), said), phrases)


def covered(refs: DataFrame, phrases: DataFrame) -> DataFrame:
    """:func:`coverage` of (id, ref, hyps: array of (engine, hyp)), where the texts stand: none is shuffled unless the phrases have to be joined."""
    p = phrases.select(terms.comparable(F.col("phrase")).alias("phrase")).where("phrase != ''").distinct()
    # What is used for every term comes out of a generator: a projection would be drawn into the lambda and worked out for each.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    r = refs.select("id", "ref", "hyps", once(terms.comparable(F.col("ref")), "r"))
    r = keywords.noted(r, ["id"], "r", p, "phrase", "near").select("id", "ref", "hyps", "near", "r", once(F.upper("r"), "u"))
    none = F.array().cast("array<string>")
    spelt = lambda c: F.transform(c, lambda t: F.struct(t.alias("t"), terms.comparable(t).alias("c")))
    r = r.select("id", "hyps", spelt(F.filter("near", lambda t: terms.occurs(t, F.col("r"), F.col("u")))).alias("ps"),
                 spelt(F.coalesce(F.array_distinct(F.transform(terms.key_terms(F.col("ref")), lambda x: x["term"])), none)).alias("ki"))
    heard = F.transform("hyps", lambda x: F.struct(x["engine"].alias("engine"), terms.comparable(x["hyp"]).alias("h")))
    heard = F.transform(heard, lambda x: F.struct(x["engine"].alias("engine"), x["h"].alias("h"), F.upper(x["h"]).alias("u")))
    j = r.select("id", "ps", "ki", F.explode(heard).alias("x")).select("id", "ps", "ki", "x.*")
    kept = lambda c: F.size(F.filter(c, lambda t: terms.occurs(t["c"], F.col("h"), F.col("u"))))
    missed = F.transform(F.filter("ki", lambda t: ~terms.occurs(t["c"], F.col("h"), F.col("u"))), lambda t: t["t"])
    j = j.select("id", "engine", F.size("ps").alias("ps_total"), kept("ps").alias("ps_hits"), F.size("ki").alias("ki_total"), kept("ki").alias("ki_hits"), F.array_sort(missed).alias("ki_misses"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    j = j.withColumns({"ps_rate": rate("ps_hits", "ps_total"), "ki_rate": rate("ki_hits", "ki_total")})
    return j.withColumn("difference", F.round(F.col("ps_rate") - F.col("ki_rate"), 4))


def draft_overlay(pairs: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(engine, candidates, overlay) from (engine, wrong, fixed, n): the most frequent pairs that are safe, as a JSON object.

    Of the ``most`` commonest pairs of an engine with ``least`` finds those stay that change a spelling of 3 characters or more,
    with only letters, digits or slashes on both sides; a spelling's commonest correction wins. Engines without a name or pair give no row.
    """
    p = pairs.where(F.coalesce(F.col("engine"), F.lit("")) != "").where(F.col("n") >= least)
    by = lambda *c: Window.partitionBy(*c).orderBy(F.desc("n"), "wrong", "fixed")
    p = p.withColumn("place", F.row_number().over(by("engine"))).where(F.col("place") <= most)
    safe = lambda c: F.col(c).rlike(r"^[A-Za-z0-9/一-鿿]+$")
    p = p.where(safe("wrong") & safe("fixed") & (F.length("wrong") >= 3) & (F.col("wrong") != F.col("fixed"))).withColumn("first", F.row_number().over(by("engine", "wrong"))).where("first = 1")
    entries = F.array_sort(F.collect_list(F.struct("wrong", "fixed")))
    return p.groupBy("engine").agg(F.count("*").alias("candidates"), F.to_json(F.map_from_entries(entries)).alias("overlay"))
