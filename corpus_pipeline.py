"""Toxicity, line dedup, near-duplicates and packing over ``documents``, one stage after the other.

Every stage gets all that the one before kept, written as Parquet and read again. Rows that repeat
an id are one document: they are kept or left out together. Documents without an id stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.llm import lines, packing, simhash, toxicity
from authsignal.llm.common import table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the multiple-instance model scores below 0.5."""
    model = toxicity.learn(docs, table(spark, folder, "labels"), keep=~toxicity.held_out())
    return toxicity.reject(docs.select(*DOCUMENT), model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without later runs of lines of 50 words or more; n_chars follows the text."""
    found = lines.deduplicate(docs, least_words=50, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("kept.n_chars"))
    return found.select("doc_id", "text", "kept.lang", "kept.source", n_chars.alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Near-duplicates by SimHash: the document of smallest id stays in each group."""
    found = simhash.near_duplicates(docs, shingle=3, radius=2)
    kept = written(found.where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    # the kept ids grow with the corpus, so they are never broadcast, at any size
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*DOCUMENT)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every piece of what is left, with its sequence of at most 4096 tokens and its place there."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("packing", packed),
]
ORACLE_SQL: str | None = None  # no stage is expressible in SQL; tests/llm compares with brute force


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
