"""The corpus pipeline: each stage is one operator, written as Parquet and read again as the next one's documents.

Filtering stages return the columns of documents: the classifier drops what it rejects, line dedup deletes later
repeated runs from texts, near-dedup keeps one document of each group, and the secret scan masks what it reports. The
last stage returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, near_dedup, packing, quality_classifier, secrets
from tessera.llm.common import delete, scratch, shared_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, counted=None)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: SQL expresses neither the trained field nor the signatures; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages leave.

    What a stage has written on its way goes when its result is written, and so does the result before; those of the last
    stage stay, as the rows that are returned are read from them.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    *first, (_, last) = STAGES
    for k, (_, stage) in enumerate(first):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            delete(spark, f"{root}/{k - 1}")
    return last(spark, docs, sf_dir)
