"""A training corpus from raw documents: known languages, one of each group of copies, personal data masked, sources
mixed to their weights, and texts encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, mixing, pieces, pii, simhash
from millrace.runtime import discard, materialize


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that every language model codes worse than any labelled text."""
    return language.keep_known(docs, language.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each SimHash class."""
    return simhash.keep_one(docs, words=4, radius=4)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; every document stays, n_chars, where there is one, follows its text."""
    clean = pii.redact(docs, pii.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source near its target; a document may be taken several times."""
    return mixing.take(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text, the digest of what they decode to, and whether that is the text again; columns of
    docs by those names give way."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), checked=True)


#: Each takes what the one before kept.
STAGES = [
    ("language", known_languages),
    ("near-duplicates", one_of_each),
    ("private data", private_data),
    ("mixing", mixed),
    ("pieces", coded),
]

#: SQL can express neither the language models nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
