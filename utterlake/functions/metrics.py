"""Text distances as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .edits import measured
from .text import word_chars  # noqa: F401 - words as characters, for Spark's own levenshtein


@F.arrow_udf(IntegerType())
def char_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return measured(a, b)


@F.arrow_udf(IntegerType())
def filtered_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return measured(a, b)


#: The same for what is filtered by its value: it would be worked out again behind the filter, unless it counts as not deterministic.
filtered_distance = filtered_distance.asNondeterministic()


@F.arrow_udf(IntegerType())
def spaced_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return measured(a, b, "spaced")


@F.arrow_udf(IntegerType())
def token_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return measured(a, b, "word")


def distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance of characters."""
    return char_distance(a, b)


def cer(ref: Column, hyp: Column, cap: bool = True, spaced: bool = False) -> Column:
    """Edit distance over the reference's length; 0 without a reference, at most 1 if capped.

    ``spaced`` puts a space between characters first, so a length change counts twice, as older reports do.
    """
    rate = (spaced_distance if spaced else char_distance)(ref, hyp) / F.length(ref)
    rate = F.least(rate, F.lit(1.0)) if cap else rate
    return F.when(F.length(ref) == 0, 0.0).otherwise(F.round(rate, 6))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of white-space tokens."""
    return token_distance(a, b)


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate on white-space tokens."""
    n = F.size(tokens(ref))
    return F.when(n == 0, 0.0).otherwise(F.round(word_distance(ref, hyp) / n, 6))
