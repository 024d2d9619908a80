"""The corpus pipeline: stages over documents, each one operator of lattika.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattika.llm.common import drop_tables, durable_table, release, table
from lattika.llm.decontamination import drop_contaminated
from lattika.llm.language_id import drop_foreign, learn
from lattika.llm.near_dedup import keep_one_of_each
from lattika.llm.piece_codec import digest, encode_documents, model_file
from lattika.llm.suffix_blocks import drop_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages of the labelled documents, and those without a letter."""
    return drop_foreign(docs, learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of copies and near copies."""
    return keep_one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of each text the 50-byte strings that also start in a document with a smaller doc_id."""
    return drop_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs, or half of whose words are one item of few words."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digest(encode_documents(docs, model_file()))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Language identification and tokenisation have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written into the shared folder before the next one reads it: nothing is computed twice, and a lost executor costs its stage alone."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = durable_table(stage(spark, docs, sf_dir))
        drop_tables(*before)
        before = [docs]
        release(spark)
    return docs
