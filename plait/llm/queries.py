"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_codec, chat, decontam, jaccard, line_dedup, scratch, suffix_dedup, token_counts, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_store(spark, store)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(spark, ann.build_index(spark, vectors), vectors, F.col("vid") % 20 == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.find_leaks(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.edits", "leak.start", "leak.end")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark, _table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_decode(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_bytes(spark, _table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], chat.PROBE)
    turns = _table(spark, sf_dir, "conversations").select(*probe.columns).union(probe)
    return chat.digest(scratch.write(chat.format_examples(turns), "chat"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_ann": op2_ann,
    "op3_decontamination": op3_decontamination,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": jaccard.SQL,
    "op7_line_dedup": line_dedup.SQL,
}
