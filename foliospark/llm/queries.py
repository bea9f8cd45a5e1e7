"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, decontaminate, fingerprints, importance, language_id, line_dedup, packing, quality, repeats, simhash, url_filter, warc, whitening
from .common import table


def _documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash_near_dedup": _documents(simhash.query_near_dedup),
    "op3_best_fit_packing": _documents(packing.best_fit_pack),
    "op4_class_lm": _documents(class_lm.query),
    "op5_line_dedup": _documents(line_dedup.query),
    "op6_url_filter": url_filter.query,
    "op7_fingerprints": _documents(fingerprints.query),
    "op8_suffix_array_dedup": _documents(repeats.query),
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": _documents(language_id.query),
    "op11_warc": warc.query,
    "op12_importance_resampling": importance.query,
    "op13_embedding_whitening": whitening.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_url_filter": url_filter.SQL,
    "op8_suffix_array_dedup": repeats.SQL,
    "op11_warc": warc.SQL,
}
