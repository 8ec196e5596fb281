"""A corpus pipeline of five stages over `documents`: each takes what the one before has kept.

Language ID, exact dedup, near-dedup and secret scans return rows of `documents`; packing, the last
one, returns the pieces of the packed sequences. Each stage takes null and empty texts, texts of any
length, repeated rows, an empty table and columns beyond those of `documents`, which it passes on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.llm.bpe import vocabulary_text
from mktlens.llm.common import Scratch, small_batches
from mktlens.llm.exact_dedup import without_copies
from mktlens.llm.language_id import learned, only_identified
from mktlens.llm.near_dedup import near_groups
from mktlens.llm.packing import best_fit_packing
from mktlens.llm.secrets import redact_secrets
from mktlens.sources import folders

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told: those with null texts or without a letter go. Rows are judged one by one.

    They are written here, where whole rows go to Python in small batches.
    """
    with small_batches(spark):
        model = learned(docs)
    return Scratch(spark).cut(only_identified(docs, model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, one row with the smallest doc_id; a row repeated with id and text stays once."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the row with the smallest doc_id.

    Texts without words, null ones among them, stay, as do rows with a null doc_id. Rows of one
    doc_id share their fate.
    """
    dropped = near_groups(docs).where("doc_id != component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with a mark in place of each secret; n_chars follows (null for a null text)."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's pieces and their places in sequences of at most 4096 tokens; null and empty texts are an end id each."""
    return best_fit_packing(docs, vocabulary_text(public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each stage's rows are written to the shared folder and read again, and deleted once the next one's are there."""
    folder = folders.new(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            folders.delete(spark, f"{folder}/{before}")
        before = name
    return docs
