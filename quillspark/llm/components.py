"""Connected components of a table of links.

Up to `ONE_TASK` links fit a few dozen megabytes: one task unites them in numpy.
Beyond, the links go through joins and aggregates, in alternating large-star and
small-star steps: every node points its larger (then its smaller) neighbours at
the least node it sees, until every node points at the least of its component. A
node's neighbours are never gathered: the least is an aggregate that combines
before the shuffle, and goes back over a join. Each round is written to the
shared folder, so a lost executor costs a task. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

ONE_TASK = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in links u-v and the least id that each reaches."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        ids, label = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["id", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for each id that has a link; component is the least id reachable."""
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    edges = materialize(edges)
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_united, "id long, component long")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        before, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(before)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
