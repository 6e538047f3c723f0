"""Corpus pipeline: stages over documents, each written and read again before the next.

Every stage but the last returns the columns of documents, whatever further ones there are, for the
rows it keeps, and works on all rows that the one before kept. A row is decided by its own text, not
by what else has its id.

Defined cases, of every stage: a null id is an id like others, but never the smallest of copies; a
null text is empty; the quality stage scores it as such, of empty texts exact deduplication keeps
one, near duplicates and decontamination keep it; of rows that repeat id and text the two
deduplications keep one; columns named as the operators' own are carried through; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, exact_dedup, near_dedup, quality, sp_codec
from ledgerloom.llm.queries import vocabulary
from ledgerloom.storage import delete, scratch, work_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that of the smallest id."""
    return exact_dedup.keep_first(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return near_dedup.keep_one(docs, width=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and the digests of ids and decoded text."""
    return sp_codec.encode_decode(docs, vocabulary("piece_bpe_32k.model"), keep=["lang", "source"], with_ids=True)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("decontaminate", clean), ("sentencepiece", encoded)]
#: The classifier's training is beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"stage-{name}")
        with scratch(spark):  # what a stage writes on its way goes when its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
