"""A training corpus from documents: language, exact copies, near copies, mixture, tokens.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
Every stage's result is written as Parquet and read again as the next one's docs. All but the last
return the columns of docs. Extra columns pass through; nulls, empty tables and repeated rows are
treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideway.llm import bpe, jaccard, langid, lsm, mixing, simhash
from strideway.llm.common import materialise, table
from strideway.llm.queries import held_out

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; those that the model rejects go."""
    return langid.accepted(docs, langid.train(docs.filter(~held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return lsm.distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """near(), and of what is left one of each group of texts whose five-word shingles are alike to 0.8 or more."""
    return jaccard.one_of_each(materialise(near(spark, docs, sf_dir), "near"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded again."""
    return bpe.digests(bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near_copies), ("mixing", mixture), ("byte-level BPE", tokens)]

#: The language model and SimHash can't be told in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
