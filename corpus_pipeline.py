"""A training-data pipeline: each stage's decisions take effect on the next.

Every stage but the last returns the columns of its input, whatever they are
named beyond doc_id, text, lang, source and n_chars.  Null texts are empty, rows
that repeat are rows of their own until the near-dedup, and an empty table stays
an empty table through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, common, mixing, nearcopies, quality, secrets
from tessera.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the base rules and go; a null doc_id is judged like
    any other but is never trusted; repeated rows are judged alike; without
    labels only the base rules decide.
    """
    return quality.filter_documents(spark, docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a resemblance of 0.8 or more.

    The smallest (doc_id, hash of the text) stays, a null doc_id last, and one of
    rows equal in both; all texts without words are one group.
    """
    return nearcopies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew where there were some.

    A null text stays null; spans that overlap get one mark.
    """
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice.

    A null source is a source of its own, the last; texts without words have no
    share in a size but are taken at their source's rate like others; rows equal
    in doc_id, source and text share one coin.
    """
    return mixing.mix(docs)


def token_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: count and digests of the ids and decoded text.

    A null or empty text has no ids; a null doc_id stays null.
    """
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mixing", source_mixing),
    ("byte-level bpe", token_encoding),
]

#: No SQL: SimHash components and byte-pair merges are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is removed once the next one's is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
