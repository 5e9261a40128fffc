"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it again for the next stage. All
but the last return the columns of documents, further ones included, whatever their
names. Very long texts are read whole by every stage, an empty table passes through
all of them, and what a stage does with nulls, ties and repeated rows stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import decontam, neardup, packing, pii, quality
from lexigrid.llm.queries import pii_key
from lexigrid.llm.runtime import prepare, shared_dir, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labelled documents of this input.

    A null text is judged as an empty one, a score of exactly 0.5 is kept, repeated
    rows are judged alike and each by itself; if the labels show one class only, all stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of the smallest doc_id stays.

    Texts without a word (null, empty) and rows without a doc_id stay; of rows that
    repeat a doc_id with its text one stays, different texts of a doc_id are documents
    of their own.
    """
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the words of benchmark passages are cut, until none is left.

    A null text stays null; repeated rows are cut alike; without a benchmark all stay as they are.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms, under the session's key or one of this run's own.

    A null text stays null; equal values, also of repeated rows, get equal pseudonyms.
    """
    return pii.pseudonymise(docs, pii_key(spark), counted=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences.

    A null or empty text is its end mark alone, also under a null doc_id; repeated rows
    are documents of their own; further columns are left behind.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: A trained classifier, signatures and tokenisation are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
