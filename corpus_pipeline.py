"""A corpus pipeline: quality, near copies, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs, whatever their names.

Null texts are empty. Rows without doc_id are no document: the quality, near-copy and benchmark stages have
no verdict on them and they stay, and the last stage has no row for them. Rows that repeat a doc_id share its verdict, and
the last stage has a row for each. Empty tables give empty ones; without labels, or without a benchmark, nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm import bpe, decontamination, jaccard, quality, secrets
from notespan.llm.common import names, table, work_folder, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scores = quality.scored(docs, table(spark, sf_dir, "labels")).where(~F.col("keep")).select("doc_id")
    return docs.join(scores, "doc_id", "left_anti").select(*names(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    others = jaccard.near_copies(docs).where("component_id != doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*names(docs))


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked."""
    return secrets.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids, with digests of the ids and of the text that they decode to."""
    return bpe.encoded(docs, bpe.vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("near copies", one_of_each),
    ("benchmarks", no_benchmarks),
    ("secrets", no_secrets),
    ("token ids", token_ids),
]

#: The classifier, the Markov model and the tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs
