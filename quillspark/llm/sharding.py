"""Operator 3: weighted rendezvous sharding, in DataFrame functions only.

Each record key scores every shard with `-ln(u) / weight`, where `u` in (0, 1)
comes from a hash of (key, shard); the shard with the lowest score takes the
record. A shard's share is proportional to its weight, and one more shard only
takes records: no other score changes.

Rows are independent of each other up to the numbering: the text never leaves
the scan, only (key, size, checksum, shard) does. Slots number each shard from
0 without sorting a whole shard in a task: every scan partition's part of a
shard is numbered on its own, behind the counts of the parts before it.

Defined results: a null text has size 16 and checksum 0; a null key is a key
like any other; repeated rows go to one shard and get slots of their own; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def scores(key: Column, weights: Sequence[float], first: int = 0) -> list[Column]:
    """The score of each shard for a key; shards are numbered from `first`."""
    out = []
    for i, weight in enumerate(weights, first):
        if not weight > 0:
            raise ValueError(f"shard {i} has weight {weight}; weights are positive")
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(i), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        out.append(-F.ln(u) / F.lit(float(weight)))
    return out


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, from 0; of equal scores the lower shard wins."""
    each = F.array(*scores(key, weights))
    return (F.array_position(each, F.array_min(each)) - 1).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """Shards `docs` (doc_id, text) by doc_id; `grown_shard` is the shard with one more of `grown_weight`."""
    n = len(weights)
    narrow = (
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.array(*scores(F.col("doc_id"), weights)).alias("each"),
            scores(F.col("doc_id"), [grown_weight], n)[0].alias("one_more"),
            F.spark_partition_id().alias("part"),
        )
        .withColumn("best", F.array_min("each"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.array_position("each", F.col("best")) - 1).cast("int").alias("shard"),
            (F.col("one_more") < F.col("best")).alias("moves"),
            "part",
        )
    )
    narrow = materialize(narrow)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        narrow.groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        narrow.withColumn("place", F.row_number().over(inside) - 1)
        .join(parts, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("place")).cast("long").alias("slot"),
            F.when(F.col("moves"), F.lit(n)).otherwise(F.col("shard")).cast("int").alias("grown_shard"),
        )
    )
