"""Operator 8: near-duplicates by MinHash with sequential Bayesian verification.

Words are taken by bytes, shingles of `k` words become 64-bit hashes, and a
signature is the least value of each of `PERMUTATIONS` hash functions over the
distinct shingles. Bands of signature values propose candidates. A candidate's
signatures are compared a batch at a time: with m of n values equal, similarity
has the posterior Beta(m + 1, n - m + 1), and once the posterior probability of
reaching the threshold falls below `MISS` the pair is dropped. Survivors are
confirmed on their full shingle sets, recomputed from the texts.

Groups stay linear. Documents with equal sets are one class from the start. A
band bucket first links each class to its least member only; components of
those confirmed links then show which buckets still hold more than one. There
members meet a few random pivots of other components. Of the buckets that are
mixed even then, small ones give all their pairs across components; large ones
are compared block by block on full sets, and only edges that join components
come back. A pair inside a component cannot change the result.

With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with
probability 5e-8.

Defined results: a text without words (or null) has an empty set and is linked
with nothing; with fewer than k words the whole sequence is one shingle; rows
that share a doc_id are one node, linked if any of their texts is; a row with
a null doc_id is linked with nothing, has a null component_id and is kept; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .hashing import BASE, mix, slice_hashes

BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
BATCH, MISS = 16, 1e-5
#: Pivots that each member of a mixed bucket meets; members up to which all pairs of a bucket that
#: is mixed even then are candidates of their own; documents of a block beyond.
PIVOTS, CROWD, BLOCK = 6, 32, 256
CHUNK = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_draw = np.random.default_rng(20)
_A = (_draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of k words."""
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        chunk.append((text or "").encode("utf-8").translate(_LOWER))
        size += len(chunk[-1])
        if size >= CHUNK:
            yield from _sets(chunk, k)
            chunk, size = [], 0
    if chunk:
        yield from _sets(chunk, k)


def _sets(chunk: list[bytes], k: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(chunk) + b" ", np.uint8)
    word = ~_BLANK[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    words = slice_hashes(data, starts, ends)
    limits = np.cumsum([1 + len(x) for x in chunk])
    first = np.concatenate(([0], np.searchsorted(starts, limits)))
    rolled = words[: max(0, len(words) - k + 1)]
    for j in range(1, k):
        rolled = mix(rolled * np.uint64(3) + words[j : len(words) - k + 1 + j])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = words[a : a + 1]
            for j in range(a + 1, b):
                whole = mix(whole * np.uint64(3) + words[j : j + 1])
            yield mix(whole + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        out = np.minimum(out, (_A[:, None] * shingles[None, i : i + 2048] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype("<u4")


@lru_cache(8)
def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch, the fewest equal values at which a pair stays: the posterior probability
    of the threshold or more, P(Binomial(n + 1, threshold) <= m), is at least `miss`."""
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sign = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                one.append(s.sum(dtype=np.uint64))
                two.append(mix(s ^ np.uint64(BASE)).sum(dtype=np.uint64))
                sign.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(sign, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that sequential verification leaves. sigs: id, sig."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, PERMUTATIONS) for i in (2, 3))
            alive = np.arange(batch.num_rows)
            equal = np.zeros(batch.num_rows, int)
            for i, m in enumerate(least):
                at = slice(i * BATCH, (i + 1) * BATCH)
                equal[alive] += (left[alive, at] == right[alive, at]).sum(axis=1)
                alive = alive[equal[alive] >= m]
            yield batch.select([0, 1]).take(pa.array(alive))

    with_a = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    with_b = with_a.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return with_b.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                for x, y in zip(shingle_sets(part.column(2).to_pylist(), k), shingle_sets(part.column(3).to_pylist(), k), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _across(placed: DataFrame, pivots: int | None) -> DataFrame:
    """Pairs (a, b) across components of a bucket: of each member with several pivots (the least
    members in as many random orders), or of all. placed: key, id, c."""
    if pivots is None:
        other = placed.select("key", F.col("id").alias("p"), F.col("c").alias("pc"))
    else:
        least = [F.min_by(F.struct(F.col("id").alias("p"), F.col("c").alias("pc")), F.xxhash64(F.lit(i), "id")) for i in range(pivots)]
        other = placed.groupBy("key").agg(F.array_distinct(F.array(*least)).alias("all")).select("key", F.inline("all"))
    pairs = placed.join(other, "key").where("c <> pc" if pivots else "c <> pc and id > p")
    return pairs.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).distinct()


def _mixed(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of buckets (key, id) those with more than one component: key, id, c, and key, n, least."""
    placed = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    sizes = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    sizes = materialize(sizes.where("lo <> hi").select("key", "n", "least"))
    return materialize(placed.join(sizes.select("key"), "key")), sizes


def _in_blocks(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across components among the members (key, id, c, least) of large mixed buckets.

    Members whose buckets overlap are a family. It is dealt into blocks of about BLOCK
    documents, a large component's apart from the rest, and pairs of blocks are compared
    on full sets in one task each; two blocks of one component are not. A pair of blocks
    returns edges that join its components, never all links."""
    one = materialize(members.select("id", "c").distinct())
    family = components(members.select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("component", "family")
    one = materialize(one.join(family, "id").select("id", "c", "family"))
    core = one.groupBy("family", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK)
    loose = one.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    dealt = one.join(core, ["family", "c"], "left").join(loose, "family")
    of = F.coalesce("n", "m")
    part = F.pmod(F.xxhash64(F.when(F.col("n").isNull(), F.col("c")).otherwise(F.col("id"))), F.ceil(of / BLOCK))
    dealt = materialize(dealt.select("id", "c", "family", F.when(F.col("n").isNotNull(), F.col("c")).alias("core"), part.alias("part")))
    held = dealt.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    name = F.concat_ws("/", F.col("family").cast("string"), F.coalesce(F.col("core").cast("string"), F.lit("")), F.col("part").cast("string"))
    blocks = materialize(held.groupBy("family", "core", name.alias("block")).agg(F.collect_list(F.struct("id", "c", "text")).alias("docs")))
    names = blocks.select("family", "core", "block")
    meet = names.join(names.select("family", F.col("core").alias("core2"), F.col("block").alias("block2")), "family")
    meet = meet.where("block <= block2 and (core is null or core2 is null or core <> core2)").select("block", "block2")
    pairs = meet.join(blocks.select("block", F.col("docs").alias("x")), "block").join(blocks.select(F.col("block").alias("block2"), F.col("docs").alias("y")), "block2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                out.extend(_block_edges(x.as_py(), y.as_py(), k, percent))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])

    return pairs.select("x", "y").mapInArrow(run, "a long, b long")


def _block_edges(x: list[dict], y: list[dict], k: int, percent: int) -> list[tuple[int, int]]:
    sets_x, sets_y = (list(shingle_sets([d["text"] for d in z], k)) for z in (x, y))
    every = np.unique(np.concatenate(sets_y))
    flat = np.searchsorted(every, np.concatenate(sets_y))
    size = np.array([len(s) for s in sets_y])
    begin, c = np.cumsum(size) - size, np.array([d["c"] for d in y])
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    out = []
    for d, s in zip(x, sets_x, strict=True):
        mark = np.zeros(len(every), np.int64)
        at = np.minimum(np.searchsorted(every, s), len(every) - 1)
        mark[at[every[at] == s]] = 1
        both = np.add.reduceat(mark[flat], begin)
        for j in np.flatnonzero((100 * both >= percent * (size + len(s) - both)) & (c != d["c"])):
            a, b = find(d["c"]), find(int(c[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((d["id"], y[j]["id"]))
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signs = materialize(signed(docs, k))
    sets = ["n_shingles", "h1", "h2"]
    full = signs.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*sets).agg(F.min("doc_id").alias("id"))
    sigs = materialize(full.join(classes.withColumn("doc_id", F.col("id")), [*sets, "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "sig").distinct())
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))
    bands = sigs.select("id", F.explode(keys).alias("key"))

    buckets = bands.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = materialize(bands.join(buckets.drop("n"), "key"))  # members of buckets with company; b: the least
    stars = materialize(crowded.where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    near = materialize(confirmed(likely(stars, sigs, percent / 100), docs, k, percent))
    found = materialize(components(near))

    placed, _ = _mixed(crowded.select("key", "id"), found)
    across = materialize(_across(placed, PIVOTS).join(stars, ["a", "b"], "left_anti"))
    near = near.unionByName(materialize(confirmed(likely(across, sigs, percent / 100), docs, k, percent)))
    found = materialize(components(near))

    placed, sizes = _mixed(placed.select("key", "id"), found)
    few = placed.join(sizes.where(F.col("n") <= CROWD).select("key"), "key", "left_semi")
    tested = stars.unionByName(across)
    across = materialize(_across(few, None).join(tested, ["a", "b"], "left_anti"))
    near = near.unionByName(confirmed(likely(across, sigs, percent / 100), docs, k, percent))
    many = placed.join(sizes.where(F.col("n") > CROWD).select("key", "least"), "key")
    near = near.unionByName(_in_blocks(many, docs, k, percent))
    found = components(near)

    named = classes.join(found, "id", "left").select(*sets, F.coalesce("component", "id").alias("component_id"))
    out = signs.select("doc_id", *sets).join(named, sets, "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
