"""A corpus made ready for training: quality, near-duplicates, personal data, mixture, packing.

Each stage works on what its predecessor kept, written as Parquet and read again.

Defined cases: null text is empty; rows with null or empty text pass the classifier if the model of the labels says so, and are no
one's near-duplicates; a document that the mix takes no words of, so each one without words, is left out of the mix; a null source
is a source of its own; of rows that share a doc_id the near-duplicates stage keeps one; rows with a null doc_id are kept by every
stage that keeps a text like theirs; texts of any length are processed whole; an empty table gives no pieces; other columns pass
the stages before the last unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import minhash_dedup, mixing, ordinal, packing, pii
from tallyweave.llm.shared import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is above the lowest with probability 0.5 or more; rejected rows go."""
    model = ordinal.train(docs, read_table(spark, sf_dir, "labels"), "quality")
    return ordinal.selected(docs, model, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that of the smallest doc_id."""
    return minhash_dedup.kept_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words that it takes of them."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, digests in place of their ids."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing sources to target weights", mixture), ("packing", sequences)]
#: The stages' models and tokeniser have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
