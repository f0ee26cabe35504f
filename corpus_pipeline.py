"""A corpus pipeline: keep what is in a known language, one of each group of near copies, and what holds no benchmark item;
take personal data out; mix the sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, mixing, pii
from tidemark.llm.session import remove_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects."""
    model = language.fit_language(docs.where(~language.held_out()))
    return language.detect_language(docs.select(COLUMNS), model).where("not rejected").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of similar ones, the one with the smallest identifier."""
    return jaccard.keep_one(docs.select(COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; rows are judged by identifier and text."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their words, the words taken, and the positions in training of all their copies."""
    return mixing.mix_sources(docs.select(COLUMNS), only_taken=True)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]

#: Language identification and the Jaccard components are not SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a table in the folder that driver and executors share.

    A table goes when the next one is written, so that at most two are there at once; the last one stays, for the result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            remove_folder(spark, last)
        last = f"{folder}/{name}"
    return docs
