"""Training-data pipeline over the table of documents: five stages, each one operator.

A stage takes the table its predecessor wrote and returns the next one. The first four keep the
columns of documents; the last returns the places of the pieces in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylens.llm import exact, jaccard, language, packing, private
from assaylens.llm.common import documents, prepare
from assaylens.session import new_path


#: Words that packing remembers, in each of two generations: the executors still hold the memory of the stages before.
WORDS = 150_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those mostly in no learned language."""
    prepare(spark)
    return language.keep_identified(docs, language.learn(language.training_rows(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of texts that are equal but for white space."""
    prepare(spark)
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each component of documents with five-word shingles alike by 0.8 or more."""
    prepare(spark)
    return jaccard.keep_one(docs, jaccard.Rule(words=5, percent=80))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    prepare(spark)
    return private.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of the documents into sequences of 2048."""
    prepare(spark)
    return packing.pack(exact.with_row(docs.select("doc_id", "text")), "word_bpe_49k.json", cached=WORDS)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("private", mask_private),
    ("packing", pack_sequences),
]

#: Language inference, the contexts and the packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
