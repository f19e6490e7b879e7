"""The corpus pipeline: language ID, exact dedup, near dedup, personal data, packing.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of documents, whatever
further columns there are and whatever they are called. In every stage an empty table gives an empty result, and a null
doc_id is a document's like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.bagminhash import keep_one
from maskweave.llm.common import staged, table
from maskweave.llm.exact import keep_first
from maskweave.llm.langid import accepted
from maskweave.llm.packing import pack
from maskweave.llm.pii import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a learned language; those without a letter (null and empty texts), gibberish and other languages go.

    Repeated rows stay or go together.
    """
    return accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the first by doc_id; null texts are empty ones. Of repeated rows one stays."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the first by doc_id; texts without a word are one class."""
    return keep_one(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars as of the new text; null texts stay null, repeated rows stay."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences in windows of 2048; null texts have their end id alone, repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal), ("packing", packing)]

#: Models, tokens and fingerprints have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
