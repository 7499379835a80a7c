"""A corpus pipeline of five stages; each reads what its predecessor has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalweave.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from vitalweave.llm.queries import Plan, secret_forest, vocabulary
from vitalweave.session import shared_dir

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the code points of the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failed lines."""
    return quality.clean(docs, "text", "n_chars")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go."""
    return _measured(decontaminate.remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return _measured(secret_scan.redact(docs, secret_forest(docs)))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, the token ids and their number of each document."""
    encoded = bpe.encode_texts(docs, vocabulary(), "text", "ids", list(DOCUMENT))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("bpe_encoding", token_stage),
]

#: The similarity join, the forest and the encoder cannot be written in SQL; tests hold the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    from uuid import uuid4

    folder = f"{shared_dir(spark)}/corpus-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_PLANS = {"pipeline": Plan("pipeline", run, ORACLE_SQL)}
