"""A training-data pipeline: each stage takes (spark, docs, sf_dir) and returns the next stage's docs.

Documents that are predicted toxic go; of each group of near-duplicates one document stays; secrets
are replaced by a mark; sources are mixed to their target weights by repeating or leaving documents;
what is left is encoded.

Every stage but the last returns the columns it was given, whatever they are called. Null and empty
texts are documents without words: not toxic unless the classifier says so, near no other, without
secrets, kept once by the mix, encoded to no ids. Rows without an id, and several rows of one id, are
told apart by their texts; of rows that repeat id and text the second stage keeps one. An empty table
gives an empty table at every stage. Ties are broken by id, then by a digest of the text, so results
do not follow partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latmix.llm import bpe, jaccard, mixing, secrets, toxicity
from latmix.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(spark, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the digests of the ids and of the bytes they decode to, and the ids."""
    import public_tokenizers

    tables = bpe.Tables(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, tables, public_tokenizers.PATTERN, "doc_id", "source", digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: The classifier's training and the merges of a vocabulary are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    read: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*read)  # the stage that read it is written
        read = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
