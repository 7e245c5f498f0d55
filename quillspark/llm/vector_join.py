"""Operator 6: vectors by cosine, joined in epsilon grid order.

Cosine c on unit vectors is distance sqrt(2 - 2c) = eps. Vectors are rotated to
their principal dimensions and sorted by the grid cells (of width eps) of the
leading ones, then by id: the epsilon grid order. The sequence is cut into
blocks. Blocks meet only where they hold the same or neighbouring cells on the
first dimensions and their bounding boxes come within eps; a pair of blocks is
then joined by halving its sequence intervals, skipping every pair of intervals
whose boxes lie further apart than eps, down to small products in double
precision.

Equal vectors are one with a multiplicity from the start. A pair of blocks
returns a number of links per vector and edges that span its groups, never the
pairs themselves, so dense groups stay linear in what is shuffled.

The rotation is fitted on at most `SAMPLE` vectors, those with the least hash of
their id; any rotation gives the same links, a good one skips more. A length that
is not in the sample keeps its first axes.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without an id, have no links and are their own component;
vectors of different lengths never link; repeated rows count as other vectors
with equal ids; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

SAMPLE, LEADING, BLOCK, LEAF = 20_000, 12, 4096, 256


def _unit(blob: bytes, width: int) -> np.ndarray:
    v = np.frombuffer(blob, "<f8").reshape(-1, width)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the leading principal directions of a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toLocalIterator()
    by: dict[int, list] = {}
    for (v,) in rows:
        by.setdefault(len(v), []).append(v)
    out = {}
    for width, vs in by.items():
        x = np.array(vs, float)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        out[width] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:LEADING].T
    return out


def _turn(turns: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The leading directions for a length; its first axes where the sample held none of it."""
    turn = turns.get(width)
    return np.eye(width, min(width, LEADING)) if turn is None else turn


def _far(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return bool((gap * gap).sum() > eps * eps)


class _Pair:
    """The join of two sequences of unit vectors (or of one with itself)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, turn: np.ndarray, times_a: np.ndarray, times_b: np.ndarray, least: float):
        self.v, self.lead, self.times = (a, b), (a @ turn, b @ turn), (times_a, times_b)
        self.same, self.least, self.eps = a is b, least, math.sqrt(2 - 2 * least) * (1 + 1e-9) + 1e-9
        self.links = (np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))
        self.edges: list[np.ndarray] = []  # rows (place in a, place in b)

    def box(self, side: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.lead[side][i:j]
        return x.min(axis=0), x.max(axis=0)

    def join(self, i: int, j: int, k: int, m: int) -> None:
        """Intervals i to j of a and k to m of b."""
        if self.same and k < i or _far(self.box(0, i, j), self.box(1, k, m), self.eps):
            return
        if j - i <= LEAF and m - k <= LEAF:
            self.leaf(i, j, k, m)
        elif j - i >= m - k and not (self.same and i == k):
            h = (i + j) // 2
            self.join(i, h, k, m)
            self.join(h, j, k, m)
        elif self.same and i == k:
            h = (i + j) // 2
            self.join(i, h, i, h)
            self.join(i, h, h, m)
            self.join(h, j, h, m)
        else:
            h = (k + m) // 2
            self.join(i, j, k, h)
            self.join(i, j, h, m)

    def leaf(self, i: int, j: int, k: int, m: int) -> None:
        hit = self.v[0][i:j] @ self.v[1][k:m].T >= self.least
        if self.same and i == k:
            np.fill_diagonal(hit, False)
            if not hit.any():
                return
            self.links[0][i:j] += hit @ self.times[0][i:j]
        else:
            if not hit.any():
                return
            self.links[0][i:j] += hit @ self.times[1][k:m]
            self.links[1][k:m] += hit.T @ self.times[0][i:j]
        # edges that span the groups of the links: each of b's places to the least of a's that it reaches
        top = j - i
        mine, theirs = np.where(hit.any(axis=1), np.arange(top), top), np.full(m - k, top)
        while True:
            new_theirs = np.minimum(theirs, np.where(hit, mine[:, None], top).min(axis=0))
            new_mine = np.minimum(mine, np.where(hit, new_theirs[None, :], top).min(axis=1))
            if (new_mine == mine).all() and (new_theirs == theirs).all():
                break
            mine, theirs = new_mine, new_theirs
        to = np.flatnonzero(theirs < top)
        from_ = np.flatnonzero(mine < np.arange(top))
        self.edges.append(np.stack((theirs[to] + i, to + k, np.ones(len(to), int)), 1))
        self.edges.append(np.stack((mine[from_] + i, from_ + i, np.zeros(len(from_), int)), 1))


def _blocks(turns: dict[int, np.ndarray], eps: float):
    """Cuts sorted rows (w, id, g, n, v, cells) into blocks of one width."""
    names = ["w", "ids", "numbers", "times", "vectors", "lo", "hi", "cells"]

    def made(width: int, rows: list[tuple]) -> pa.RecordBatch:
        blob = np.array([r[3] for r in rows], "<f8").tobytes()
        lead = _unit(blob, width) @ _turn(turns, width)
        cells = [[a, b] for a, b in sorted({(r[4][0], r[4][1]) for r in rows})]
        row = ([width], *([np.array([r[k] for r in rows], "<i8").tobytes()] for k in range(3)), [blob], [lead.min(axis=0)], [lead.max(axis=0)], [cells])
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        width = 0
        for batch in batches:
            for w, i, g, n, v, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (w != width or len(held) >= BLOCK):
                    yield made(width, held)
                    held = []
                width = w
                held.append((i, g, n, v, cells))
        if held:
            yield made(width, held)

    return run


def similar_vectors(vectors: DataFrame, least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of `vectors` (vec_id, embedding)."""
    eps = math.sqrt(2 - 2 * least)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    # a sum of squares that leaves the range of doubles has no direction either
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    valid = valid & F.coalesce((square > 0) & (square < F.lit(float("inf"))), F.lit(False))
    rows = rows.withColumn("v", F.when(valid, F.col("v")))
    distinct = materialize(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("g", F.monotonically_increasing_id()))  # numbered once, in the table
    turns = _rotations(distinct)

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column(3).to_pylist():
                x = np.array(v)
                c = np.floor((x / math.sqrt((x * x).sum())) @ _turn(turns, len(v)) / eps).astype(int).tolist()
                cells.append((c + [0, 0])[: max(2, len(c))])
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in batch.column(3)], pa.int32()), *batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["w", "id", "g", "n", "v", "cells"])

    grid = distinct.select("id", "g", "n", "v").mapInArrow(gridded, "w int, id long, g long, n long, v array<double>, cells array<int>")
    count = distinct.count()
    tasks = max(1, -(-count // block))
    # where the session deals into more parts than asked for, neighbouring ones are read by one task: blocks stay full
    ordered = grid.repartitionByRange(tasks, "w", "cells", "g").sortWithinPartitions("w", "cells", "g").coalesce(tasks)
    shape = "w int, ids binary, numbers binary, times binary, vectors binary, lo array<double>, hi array<double>, cells array<array<int>>"
    blocks = materialize(ordered.mapInArrow(_blocks(turns, eps), shape).withColumn("b", F.monotonically_increasing_id()))

    # which blocks can meet: by the cells on two dimensions that they hold, then by their boxes
    cell = blocks.select("b", "w", "lo", "hi", F.explode("cells").alias("c")).select("b", "w", "lo", "hi", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))
    near = cell.select(
        F.col("b").alias("b2"), "w", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.expr("flatten(transform(sequence(x - 1, x + 1), i -> transform(sequence(y - 1, y + 1), j -> struct(i as x, j as y))))")).alias("at")
    ).select("b2", "w", "lo2", "hi2", "at.x", "at.y")
    gaps = F.transform(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda z: F.greatest(F.lit(0.0), z["lo"] - z["hi2"], z["lo2"] - z["hi"]))
    meet = (
        cell.join(near, ["w", "x", "y"])
        .where("b <= b2")
        .where(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= eps * eps * (1 + 1e-9) + 1e-9)
        .select("b", "b2")
        .distinct()
    )
    one = blocks.select("b", "w", "ids", "numbers", "times", "vectors")
    two = blocks.select(F.col("b").alias("b2"), F.col("ids").alias("ids2"), F.col("numbers").alias("numbers2"), F.col("times").alias("times2"), F.col("vectors").alias("vectors2"))
    pairs = meet.join(one, "b").join(two, "b2").select("b", "b2", "w", "ids", "numbers", "times", "vectors", "ids2", "numbers2", "times2", "vectors2")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, b2, w, ids, numbers, times, vectors_, ids2, numbers2, times2, vectors2 = (c[i].as_py() for c in batch.columns)
                x = _unit(vectors_, w)
                y = x if b == b2 else _unit(vectors2, w)
                p = _Pair(x, y, _turn(turns, w), np.frombuffer(times, "<i8"), np.frombuffer(times2, "<i8"), least)
                p.join(0, len(x), 0, len(y))
                of, by = ((np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")) for x, y in ((ids, ids2), (numbers, numbers2)))
                some = [np.flatnonzero(n) for n in p.links]
                counted = np.concatenate([by[s][some[s]] for s in (0, 1)])
                number = np.concatenate([p.links[s][some[s]] for s in (0, 1)])
                edges = np.unique(np.concatenate(p.edges), axis=0) if p.edges else np.empty((0, 3), int)
                left = of[0][edges[:, 0]]
                right = np.where(edges[:, 2] == 1, of[1][np.minimum(edges[:, 1], len(of[1]) - 1)], of[0][np.minimum(edges[:, 1], len(of[0]) - 1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((counted, left))), pa.array(np.concatenate((number, np.zeros(len(left), np.int64)))), pa.array([*[None] * len(counted), *right.tolist()], pa.int64())],
                    names=["key", "links", "other"],
                )

    found = materialize(pairs.mapInArrow(joined, "key long, links long, other long"))
    # links count for a vector, by its number, since unlike vectors may share an id; components are of ids
    links = found.where("other is null").groupBy(F.col("key").alias("g")).agg(F.sum("links").alias("links"))
    together = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    known = distinct.join(links, "g", "left").join(together, "id", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
