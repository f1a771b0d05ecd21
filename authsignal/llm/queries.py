"""The registered queries of the corpus operators, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authsignal.functions.shared import new_path
from authsignal.llm import (
    ann,
    bpe,
    conversations,
    licences,
    lines,
    packing,
    personal,
    simhash,
    tokens,
    toxicity,
    vector_join,
    warc,
    whitening,
)
from authsignal.llm.common import table
from authsignal.llm.oracle import LLM_ORACLE as LLM_ORACLE


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deduplicate(table(spark, folder, "documents"), least_words=50)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"), keep=~toxicity.held_out())
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_sentences",
        F.size("spans").alias("n_offending"),
        "spans",
    )


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    manifest = warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(manifest, path).drop("url")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op6_token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "token_file")
    tokens.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = tokens.digests(tokens.read_tokens(spark, path))
    found = tokens.with_starts(rows, tokens.range_starts(spark, path))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    return vector_join.near_duplicates(table(spark, folder, "embeddings"), least=0.93)


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, most=5)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, components=16))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, folder, "conversations"))


def op13_personal(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return personal.digest(personal.scan(docs, personal.learn(docs)))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_licences": op5_licences,
    "op6_token_file": op6_token_file,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_vector_join": op8_vector_join,
    "op9_neighbours": op9_neighbours,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_personal": op13_personal,
}
