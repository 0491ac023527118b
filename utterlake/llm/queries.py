"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_model, html_text, jaccard_join, masked_lm, media, mixture, packing, quality_rules, secret_scan, substring_dedup, url_filter, vector_codes, whitening
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(documents(spark, sf_dir))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_model.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(documents(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, one after the other, so that the second meets the ledger of the first."""
    d = documents(spark, sf_dir)
    second = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1, F.lit(False))
    return secret_scan.report_history([d.where(~second), d.where(second)])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.long_form(whitening.whiten(documents(spark, sf_dir, "embeddings")))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(documents(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(documents(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_media_columns, op3_mixture, op4_quality_classifier, op5_html_text, op6_jaccard_join, op7_substring_dedup, op8_masked_lm, op9_packing, op10_secret_scan,
        op11_whitening, op12_url_filter, op13_vector_codes,
    )
}
ORACLE: dict[str, str] = {"op3_mixture": mixture.oracle(), "op12_url_filter": url_filter.oracle()}
