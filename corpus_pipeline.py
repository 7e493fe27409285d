"""A training-data pipeline over `documents`: five stages, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again for the next
one. All but the last return the columns of docs. Nulls, empty texts, repeated rows and extra columns follow the
operators' own rules (see their modules); every stage maps an empty table to an empty table.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treegauge.llm import bpe, line_dedup, mixing, near_texts, toxicity
from treegauge.llm.common import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or nearly so, go from the texts; documents stay."""
    return line_dedup.drop_duplicate_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, of its smallest id; null and repeated ids are no exception.

    Documents without words (null or empty text) are no copies of each other and stay.
    """
    return near_texts.drop_near_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each time that the mix takes a document."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, as counts and digests, one row a document taken."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the toxicity model nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
