"""Registered queries of the corpus operators, over their whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers

from treegauge.llm import bpe, licenses, line_dedup, manifest, mixing, near_texts, near_vectors, pii, quality, sharding, token_counts, toxicity, whitening
from treegauge.llm.common import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_near_vectors")
def near_vector_rows(spark, sf_dir):
    return near_vectors.audited_vectors(read_table(spark, sf_dir, "embeddings"))


@query("op2_line_dedup", line_dedup.SQL)
def line_dedup_rows(spark, sf_dir):
    return line_dedup.duplicate_lines(read_table(spark, sf_dir, "documents")).drop("content")


@query("op3_token_counts")
def count_tokens(spark, sf_dir):
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     public_tokenizers.PATTERN)


@query("op4_bpe")
def encode_documents(spark, sf_dir):
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_mix_sources", mixing.SQL)
def mix_sources(spark, sf_dir):
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


@query("op6_quality_rules")
def quality_rules(spark, sf_dir):
    return quality.score_documents(read_table(spark, sf_dir, "documents"))


@query("op7_near_texts")
def join_near_texts(spark, sf_dir):
    return near_texts.join_near_texts(read_table(spark, sf_dir, "documents"))


@query("op8_license_scan", licenses.SQL)
def license_scan(spark, sf_dir):
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def score_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op10_sharding", sharding.SQL)
def shard_documents(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


@query("op11_personal_data")
def find_personal_data(spark, sf_dir):
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


@query("op12_manifest", manifest.SQL)
def verify_documents(spark, sf_dir):
    return manifest.verify_documents(read_table(spark, sf_dir, "documents"))


@query("op13_whitening")
def whiten(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))
