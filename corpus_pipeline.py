"""A corpus pipeline over `documents`: each stage rewrites the table that the one before it kept.

Every stage works on all rows of its input. Rows that share a doc_id share their
fate; a null text passes the first four stages unless its class is rejected.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import release, shared_folder, table
from quillspark.llm.minhash import near_duplicates
from quillspark.llm.packing import pack_documents
from quillspark.llm.pii import mask
from quillspark.llm.quality import features, score, train
from quillspark.llm.suffix_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    docs = docs.select(*COLUMNS)
    rows = features(docs, table(spark, sf_dir, "labels"))
    model = train(rows)
    release(rows)
    return score(docs, model).where("kept").select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays."""
    gone = near_duplicates(docs, k=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that also start earlier are cut from the texts."""
    cut = without_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in each text gives way to the name of its kind."""
    return mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences of 1024 tokens."""
    path = public_tokenizers.path
    return pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near),
    ("repeated_passages", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
#: Tokenizing and the classifier have no form in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
