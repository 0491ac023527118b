"""Many terms looked for in one pass over each text, by an automaton that is built once in a task and fed Arrow batches.

A term list has to fit an executor; its size in bytes is measured first. Longer lists are joined by their first three
characters with the distinct runs of that length of each text, by keys of its content, and then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Bytes of terms, each with what a node of the automaton takes beside, that go to every task.
MOST_BYTES, NODE = 32 * 2**20, 64
#: Rows after which a batch of hits is handed on.
HITS = 50_000


def windows(c: Column, n: int) -> Column:
    """All runs of ``n`` characters, overlapping. One pass: the run is looked ahead at from every character."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def starts(c: Column) -> Column:
    """The distinct runs of one to three characters of a text."""
    return F.array_distinct(F.flatten(F.array(*[windows(c, n) for n in (1, 2, 3)])))


def distinct_terms(terms: DataFrame, term_col: str) -> DataFrame:
    return terms.select(F.lower(term_col).alias("term")).where("term != ''").distinct()


def automaton(words: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, w in enumerate(words):
        a.add_word(w, i)
    a.make_automaton()
    return a


def searched(texts: DataFrame, keep: list[str], text_col: str, words: list[str]) -> DataFrame:
    """(keep, term) for each of ``words`` that a text has, once a row; case counts here, a null text has none. Streams too."""
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = automaton(words) if words else None, pa.array(words, pa.string())
        for batch in batches:
            rows, hits = [], []

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at = pa.array(rows, pa.int32())
                return pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keep))], names.take(pa.array(hits, pa.int32()))], names=[*keep, "term"])

            for row, t in enumerate(batch.column(len(keep)).to_pylist() if found else ()):
                own = {k for _, k in found.iter(t)} if t else ()
                rows.extend([row] * len(own))
                hits.extend(own)
                if len(rows) >= HITS:
                    yield out()
                    rows, hits = [], []
            if rows:
                yield out()

    return texts.select(*keep, F.col(text_col)).mapInArrow(scan, f"{kinds}, term string")


def few(t: DataFrame, most_bytes: int) -> bool:
    """Whether the distinct terms ``t`` go to every task."""
    return (t.agg(F.sum(F.octet_length("term") + NODE)).first()[0] or 0) <= most_bytes


def noted(texts: DataFrame, keys: list[str], text_col: str, terms: DataFrame, term_col: str, name: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``texts`` with all of ``terms`` that occur in a text, case aside, as the array ``name``, spelt as they are given (each spelling once), where it stands.

    ``keys`` are a row's own, for lists that have to be joined.
    """
    t = terms.select(F.lower(term_col).alias("term"), F.col(term_col).alias("__as")).where("term != ''").distinct()
    if not few(t, most_bytes):
        hits = occurring(texts, keys, text_col, terms, term_col, most_bytes).join(t, "term").groupBy(*keys).agg(F.collect_set("__as").alias(name))
        return texts.join(hits, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    spelt: dict[str, list[str]] = {}
    for term, given in sorted(map(tuple, t.collect())):
        spelt.setdefault(term, []).append(given)

    @F.arrow_udf(ArrayType(StringType()))
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found, names = automaton(list(spelt)) if spelt else None, list(spelt.values())
        for batch in batches:
            own = [[x for k in {k for _, k in found.iter(t)} for x in names[k]] if found and t else [] for t in batch.to_pylist()]
            yield pa.array(own, pa.list_(pa.string()))

    return texts.withColumn(name, scan(F.lower(text_col)))


def occurring(texts: DataFrame, keep: list[str], text_col: str, terms: DataFrame, term_col: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keep, term): the distinct terms, in lower case, that occur in a text as substrings, case aside; one row per text row and term."""
    t = distinct_terms(terms, term_col)
    d = texts.select(*keep, F.lower(text_col).alias("__text"))
    if few(t, most_bytes):
        return searched(d, keep, "__text", sorted(r[0] for r in t.collect()))
    keyed = lambda rows: rows.withColumn("__g", F.explode(starts(F.col("__text")))).join(t.withColumn("__g", F.left("term", F.lit(3))), "__g")
    here = F.contains("__text", "term")
    if texts.isStreaming:  # a line of a stream goes along with its keys; a table's text is met again by its content
        return keyed(d).where(here).select(*keep, "term")
    d = d.withColumns({"__h1": F.xxhash64(F.lit(1), *keep, "__text"), "__h2": F.xxhash64(F.lit(2), *keep, "__text")})
    pairs = keyed(d.select("__h1", "__h2", "__text")).select("__h1", "__h2", "term").distinct()
    return d.join(pairs, ["__h1", "__h2"]).where(here).select(*keep, "term")
