"""Rows that hang together: deletions that reach other tables, prices with fallbacks, and layouts of training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(children: DataFrame, gone: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The children that stay once the parents in ``gone`` are deleted; children without a parent stay."""
    return children.join(gone.select(F.col(parent_key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")


def set_null(children: DataFrame, gone: DataFrame, key: str, parent_key: str) -> DataFrame:
    """All children, those of deleted parents without a parent from now on."""
    lost = gone.select(F.col(parent_key).alias("__gone")).distinct()
    return children.join(lost, F.col(key) == F.col("__gone"), "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def token_cost(calls: DataFrame, prices: DataFrame, defaults: dict[str, tuple[float, float]], default: str, rate: float, digits: tuple[int, int] = (6, 4)) -> DataFrame:
    """``calls`` (model, tokens_in, tokens_out, ...) with ``usd``, ``local`` and ``fallback``.

    A model's prices for a million tokens come from ``prices`` (model, usd_in, usd_out), if it has both there. Else they
    are those of ``defaults``, and of the model ``default`` if it isn't there either; such calls are marked.
    """
    p = prices.where("usd_in is not null and usd_out is not null").select(F.col("model").alias("__m"), "usd_in", "usd_out")
    known = F.create_map(*[F.lit(x) for m, (a, b) in defaults.items() for x in (m, [a, b])])
    other = F.coalesce(F.try_element_at(known, F.col("model")), F.element_at(known, F.lit(default)))
    priced = calls.join(p, F.col("model") == F.col("__m"), "left").withColumn("fallback", F.col("__m").isNull())
    each = lambda n, i, c: F.col(n) / F.lit(1_000_000.0) * F.coalesce(F.col(c), other[i])
    usd = each("tokens_in", 0, "usd_in") + each("tokens_out", 1, "usd_out")
    return priced.withColumn("usd", F.round(usd, digits[0])).withColumn("local", F.round(usd * rate, digits[1])).drop("__m", "usd_in", "usd_out")


def audio_record() -> Column:
    """A training record of sound and text from (id, event_type, path, text, duration_sec, notes)."""
    seconds = F.coalesce(F.col("duration_sec").cast("double"), F.lit(0.0))
    return F.struct("id", "event_type", F.col("path").alias("audio_filepath"), "text", seconds.alias("duration"), F.coalesce("notes", F.lit("")).alias("source"))


def paired_record() -> Column:
    """The same as a pair of source and target with their lengths, in milliseconds and characters."""
    ms = F.floor(F.coalesce(F.col("duration_sec").cast("double"), F.lit(0.0)) * 1000).cast("long")
    return F.struct(F.col("id").alias("key"), F.col("path").alias("source"), ms.alias("source_len"), F.col("text").alias("target"), F.length("text").cast("long").alias("target_len"), "event_type")


#: What counting the characters of a reference leaves out.
UNCOUNTED = r"[\s,，。.、:：;；!?！？\-—()（）\"'“”\[\]【】]+"


def reference_size(text: Column) -> Column:
    """struct(chars, speaker_lines): letters of a reference without speaker marks and punctuation, and lines that a speaker begins."""
    speaker = r"(?m)^[A-Z?]:"
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x).rlike("^[A-Z?]:"))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), speaker, ""), UNCOUNTED, "")
    return F.struct(F.length(bare).cast("long").alias("chars"), F.size(lines).cast("long").alias("speaker_lines"))
