"""A training-data pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm import jaccard_join, mixture, packing, quality_rules, secret_scan
from utterlake.llm.common import documents, drop_written, settled


# An empty table passes every stage as one.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go; null, empty and wordless texts fail the base and go. Repeated rows share a verdict; other columns go along."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, of repeated rows one; a null id is smallest. Texts without words all stay, other columns go along."""
    return jaccard_join.first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, repeated ones and null and empty texts too, with its other columns; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, by the target of their source; a null source is one, texts without words have size 0, and a rate of 0 leaves them out."""
    return mixture.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and their place in it; null and empty texts are the end id alone, repeated rows are packed each, other columns go."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mix), ("packing", pack),
]
#: Hubs and components, and a search for packings, are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's tables, its predecessor's documents among them, go once its own are written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
