"""The registered queries of this subpackage; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import source_divergence
from .fingerprints import search
from .licenses import scan_licenses
from .minhash import near_duplicates
from .mixing import mix
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import pack_documents
from .pieces import encoding_report
from .pii import pii_report
from .quality import quality_report
from .sharding import shard_documents
from .suffix_dedup import dedup_report
from .token_alignment import alignment_report
from .vector_join import similar_vectors


def op1_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = search(docs.select(docs["doc_id"].alias("id"), docs["text"].cast("binary").alias("media")), every_shift=True)
    return found.withColumnRenamed("id", "doc_id")


def op2_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 40)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op8_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment_report(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def op13_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chroma_search, op2_vector_best_fit, op3_rendezvous_shards, op4_pii, op5_co_training, op6_epsilon_grid, op7_suffix_arrays, op8_bayes_minhash, op9_license_scan, op10_piece_coding, op11_source_divergence, op12_token_alignment, op13_pareto_mix)}
