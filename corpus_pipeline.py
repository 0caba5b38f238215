"""A training-corpus pipeline over documents, from raw rows to packed sequences.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame; run() writes each result to the shared folder as
Parquet and reads it again for the next. All but the last return the columns of
documents. Null texts count as empty, repeated rows are met by exact dedup, and
an empty table runs through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanloom import importable
from spanloom.llm import exact_dedup, near_copies, packing, pii, toxicity
from spanloom.llm.common import read, stage


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays."""
    return exact_dedup.deduplicate(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash, or five-word Jaccard of 0.8, stays."""
    return near_copies.keep_one_linked(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; n_chars follows the new text."""
    return pii.with_surrogates(docs, pii.key_of(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, each with its sequence and offset."""
    return packing.place_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("simhash_near_dedup", near_dedup_filter),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", pack_sequences),
]

#: No SQL can express the classifier and the fingerprints; tests/llm checks the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
