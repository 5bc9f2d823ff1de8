"""Registered queries of this subpackage over the driver's tables, and DuckDB texts of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import embeddings, language, mixing, pieces, pii, preference, quality, simhash, substrings, tokens
from millrace.runtime import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def _held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counted.withColumnRenamed("id", "doc_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~_held_out("doc_id")))
    return language.predict(docs.select("doc_id", "text"), model).select(F.col("id").alias("doc_id"), _held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_format(_table(spark, sf_dir, "conversations"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(quality.POLICIES["base"].mask).cast("bigint")) != 0
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(_table(spark, sf_dir, "documents"), window=20).withColumnRenamed("id", "doc_id")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98).withColumnRenamed("id", "vec_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language": op2_language,
    "op3_preference": op3_preference,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_pieces": op8_pieces,
    "op9_substrings": op9_substrings,
    "op10_embeddings": op10_embeddings,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_preference": preference.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_quality": quality.ORACLE,
    "op9_substrings": substrings.ORACLE,
    "op10_embeddings": embeddings.ORACLE,
}
