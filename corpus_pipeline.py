"""A corpus pipeline of five stages, each of which reads what its predecessor kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. The last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, language_id, line_dedup, packing, simhash
from foliospark.llm.common import cut, in_training, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in some learnt language, as they are; those that are null or without a letter go.

    Null ids and languages are kept, repeated rows stay repeated, texts are read
    whole, an empty table stays empty, and other columns than those of documents go.
    """
    trained = language_id.train_model(docs.where(in_training(F.col("doc_id"), 3, 1)).select("text", "lang"))
    if not trained.model.langs:  # nothing to tell documents apart by
        return docs.select(*COLUMNS)
    return language_id.keep_known(docs.select(*COLUMNS), trained)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stay in another document; n_chars is counted again where lines went.

    Null and empty texts are as they were; texts are read whole. Null ids count
    for no line. Of documents with a common line that with the largest doc_id
    keeps it; repeated rows lose the same lines and stay repeated. An empty table
    stays empty, and other columns than those of documents go.
    """
    d = line_dedup.line_dedup(docs.select(*COLUMNS))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return d.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Texts are fingerprinted whole; null and empty ones and those of blanks only
    are copies of each other. A row without an id stays only where none of its group has one; of rows
    repeated with id and text one stays. An empty table stays empty, and other columns than those of documents go.
    """
    return simhash.near_dedup(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more lies in benchmark passages.

    Null and empty texts are clean and stay; texts are scanned whole; repeated
    rows and rows with one doc_id or none are judged each on its own text. With
    an empty benchmark all documents stay, an empty table stays empty, and other columns than those of documents go.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens.

    A null or empty text is one piece of the end id; longer texts than a sequence
    are cut into as many pieces as they need. Repeated rows and null ids are
    packed as they come, an empty table gives no row, and no column but doc_id is kept.
    """
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models and token ids can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
