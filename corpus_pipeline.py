"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, token ids.

Each stage works on all that the one before kept; its result is written as Parquet and read again. All but the last
return the columns of documents, whatever further ones these have; the last returns token ids and digests of the
documents that are left. Empty tables stay empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm import bpe_codec, decontam, jaccard, line_dedup, scratch, toxicity


def _packed(docs: DataFrame) -> DataFrame:
    """Documents as doc_id, text and a struct of the other columns, so that none of these meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"))


def _rows(packed: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs out of packed rows, some of them changed."""
    return packed.select(*[(F.col("text") if c == "text" else changed.get(c, F.col("row")[c])).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of documents that aren't held out, does not reject. Null and
    empty texts stay, as do all documents when there are no labels of both classes; each row is judged by itself."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _rows(toxicity.score(spark, _packed(docs), model).filter(F.col("score") < toxicity.THRESHOLD), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more share, kept in the largest of them; n_chars follows the text. A null
    text becomes empty; rows that share an id are one document, and each keeps its own text."""
    cleaned = line_dedup.dedup_lines(_packed(docs))
    return _rows(cleaned, docs, n_chars=F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id of documents linked by five-word shingles at 0.8. Documents without
    words and rows without an id stay; rows that share an id stay or go together, and go when one of them is linked with
    a smaller id."""
    groups = jaccard.near_duplicates(spark, docs.select("doc_id", "text"), width=5, num=80, den=100)
    rest = groups.filter(F.col("component_id") < F.col("doc_id")).select("doc_id")
    return docs.join(rest, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts stay, as do all with an empty benchmark."""
    found = decontam.find_leaks(spark, _packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _rows(found.filter(F.size("leaks") == 0), docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the bytes that they decode to; null and empty texts have none. Every row
    gives a row."""
    coded = bpe_codec.encode_decode(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("token_ids", to_tokens),
]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
