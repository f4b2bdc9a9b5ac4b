"""A training corpus from raw documents: five stages, each written out and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it
kept.  All but the last return the columns of ``documents``; the last one returns token
counts and digests of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from umbraline.llm import byte_bpe, decontaminate, line_quality, private_data, simhash
from umbraline.llm.common import remove, shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    return line_quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def no_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that give it away replaced."""
    return private_data.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text: counts, and digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("private data", no_private_data),
    ("byte-level bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again.

    A stage's rows are deleted once the next one has written its own.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs


#: Forward-backward and fingerprints are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None
