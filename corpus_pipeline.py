"""From raw documents to token digests: five stages, each a DataFrame of documents to the next.

All stages take nulls in any column, empty and very long texts, repeated rows and extra columns; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowkit.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing
from flowkit.llm.common import checkpoint, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus teaches; the others go, and so do texts that are null or have no letter."""
    return language_id.accept(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the one with the least doc_id; null counts as empty, a null id comes last."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8; texts without words all stay."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a row for each pass that takes words of a document. A null source is one of
    its own, and documents without words are never taken."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix holds, a row each; a null text has no tokens."""
    return byte_bpe.encode_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("byte_bpe", encode)]

#: The language filter and the permutations of the mix are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is checkpointed for the next, so each is computed once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
