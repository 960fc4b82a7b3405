"""The registered queries of the operators: each applies one operator, with production
parameters, to its whole table and derives the contract's columns from the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import bpe, convrepair, decontaminate, linededup, ngramjoin, packing, pii, repetition, resampling, secrets, sharding, tokencount, toxicity
from marrow.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@_query
def op2_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.score(_table(spark, sf_dir, "documents"), n=4, percent=85)


@_query
def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@_query
def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op5_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans")


@_query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@_query
def op7_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@_query
def op8_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score(_table(spark, sf_dir, "documents")).drop(
        "longest_repeat", "n_repeats", "repeat_spans")


@_query
def op9_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped_lines"))


@_query
def op11_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"),
                  public_tokenizers.PATTERN)
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), *vocabulary), *vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = convrepair.damaged(_table(spark, sf_dir, "conversations"))
    return convrepair.audits(rows, present="present").drop("peak")


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
