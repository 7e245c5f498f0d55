"""Operator 7: repeated byte strings removed, by suffix arrays over shards.

Every byte is removed that a string of `WIDTH` bytes covers which also starts
earlier (in a smaller doc_id, or earlier in the same document).

To sort all suffixes of a large corpus is out of reach, and most of it repeats
nothing. So the windows of WIDTH bytes are first divided by content: a window
belongs to the least hash among its strings of `GRAM` bytes, its anchor. Equal
windows have equal anchors, so that nothing is lost, and the windows of one
anchor stand in a row: its span.

1. Anchors go to buckets by their hash as a few bytes each. Of the spans with
   one anchor hash, equal ones name the earliest as their lead and the others
   are covered; a map task does that for its own rows first, so that a very
   common passage reaches a bucket once a task. Where an anchor hash has only
   one span nothing repeats.
2. Where it has several, the leads' texts go to a shard by anchor hash. A shard
   builds suffix arrays (Larsson and Sadakane's refinement in numpy) over blocks
   of bounded size, takes common prefixes in Kasai's order, and of each class of
   equal windows keeps the earliest. Blocks that share an anchor hash are merged
   by binary search of the later block's windows in the earlier block's array.
3. Covered ranges join the documents once more, which gives what is kept.

Defined results: a null text counts as empty; rows that share a doc_id count as
one document at equal places, so a repeated row removes nothing from the other;
a row with a null doc_id is left whole; an empty table gives an empty result;
further columns of the input are ignored. Texts of any length are cut into
stretches of windows, never shortened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hashing import mix, slice_hashes, window_hashes
from .suffix_arrays import common_prefixes, find, suffix_array

WIDTH, GRAM = 100, 32
#: Bytes of text that a map task, a bucket and a suffix array take at a time.
MAP_BLOCK, BUCKET_TEXT, SHARD_BLOCK, STRETCH = 32 << 20, 2 << 20, 2 << 20, 1 << 20

ROW = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<u4"), ("run", "<u2"), ("gram", "<u8"), ("span", "<u8")])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, run, gram) of each span: its first window, its number of windows, its anchor's hash."""
    out = []
    for at in range(0, len(data) - WIDTH + 1, STRETCH):
        part = data[at : at + STRETCH + WIDTH - 1]
        grams = window_hashes(part, GRAM)
        low = np.uint64((1 << 21) - 1)
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, windows = 1, WIDTH - GRAM + 1
        while 2 * span <= windows:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        best = np.minimum(best[: len(best) - (windows - span)], best[windows - span :])
        where = (best & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        out.append((first + at, np.diff(np.append(first, len(where))), grams[where[first]]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(doc: int, row: int, text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    start, run, gram = anchors(data)
    out = np.empty(len(start), ROW)
    out["doc"], out["row"], out["start"], out["run"], out["gram"] = doc, row, start, run, gram
    out["span"] = mix(slice_hashes(data, start, start + run + WIDTH - 1) + run.astype(np.uint64)) if len(start) else 0
    return out


def _leads(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by (gram, span, place); which of them an earlier equal span covers; whose gram has several spans."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["span"], rows["gram"]))]
    gram = np.concatenate(([True], rows["gram"][1:] != rows["gram"][:-1]))
    span = gram | np.concatenate(([True], rows["span"][1:] != rows["span"][:-1]))
    begin = np.maximum.accumulate(np.where(span, np.arange(len(rows)), 0))
    lead = rows[begin]
    covered = (rows["doc"] != lead["doc"]) | (rows["start"] != lead["start"])
    group = np.cumsum(gram) - 1
    several = np.bincount(group[span], minlength=group[-1] + 1)[group] > 1
    return rows, covered, several


def _packed(rows: np.ndarray, kind: str, bucket: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True):
        part = rows[a:b]
        place = b"".join(part[c].tobytes() for c in ("doc", "row", "start", "run"))
        yield int(bucket[a]), kind, b - a, pa.compress(place, codec="zstd", asbytes=True), part["gram"].tobytes() + part["span"].tobytes()


def _unpacked(n: int, place: bytes, hashes: bytes) -> np.ndarray:
    out, at = np.empty(n, ROW), 0
    place = pa.decompress(place, decompressed_size=22 * n, codec="zstd", asbytes=True)
    for c, size in (("doc", 8), ("row", 8), ("start", 4), ("run", 2)):
        out[c] = np.frombuffer(place, ROW[c], n, at)
        at += size * n
    out["gram"], out["span"] = np.frombuffer(hashes, "<u8", n), np.frombuffer(hashes, "<u8", n, 8 * n)
    return out


def _map_side(buckets: int):
    """Rows (bucket, kind, n, place, hashes): `single` anchors for their bucket, `several` for a gram
    that has more than one span already here, and, for any bucket, `want`ed leads and `covered` spans."""
    names = ["bucket", "kind", "n", "place", "hashes"]

    def block(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(found)
        if not len(rows):
            return
        rows, covered, several = _leads(rows)
        lead = ~covered
        single, want = rows[lead & ~several], rows[lead & several]
        note = want[np.concatenate(([True], want["gram"][1:] != want["gram"][:-1]))] if len(want) else want
        out: list[tuple] = []
        for kind, part in (("single", single), ("several", note), ("want", want), ("covered", rows[covered])):
            if len(part):
                key = mix(part["gram"]) if kind in ("single", "several") else mix(part["doc"].view(np.uint64))
                if kind != "covered":
                    order = np.lexsort((part["start"], part["doc"]))
                    part, key = part[order], key[order]
                out.extend(_packed(part, kind, (key % np.uint64(buckets)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8")
                found.append(_spans(doc, row, data))
                size += len(data)
                if size >= MAP_BLOCK:
                    yield from block(found)
                    found, size = [], 0
        if found:
            yield from block(found)

    return run


def _by_doc(rows: np.ndarray, kind: str) -> Iterator[tuple]:
    rows = rows[np.lexsort((rows["start"], rows["row"], rows["doc"]))]
    cut = np.flatnonzero(np.concatenate(([True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["row"][1:] != rows["row"][:-1]))))
    for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True):
        part = rows[a:b]
        grams = part["gram"].tobytes() if kind == "want" else b""
        yield int(part["doc"][0]), int(part["row"][0]), kind, part["start"].tobytes(), part["run"].tobytes(), grams


FOUND = "doc_id long, row long, kind string, starts binary, runs binary, grams binary"
_FOUND_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())


def _found_table(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_TYPES, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def _bucket_side(table: pa.Table) -> pa.Table:
    parts = {k: [] for k in ("single", "several", "want", "covered")}
    for kind, n, place, hashes in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "place", "hashes")), strict=True):
        parts[kind].append(_unpacked(n, place, hashes))
    out: list[tuple] = []
    for kind in ("want", "covered"):
        if parts[kind]:
            out.extend(_by_doc(np.concatenate(parts[kind]), kind))
    if parts["single"]:
        rows, covered, several = _leads(np.concatenate(parts["single"]))
        if parts["several"]:
            several |= np.isin(rows["gram"], np.concatenate(parts["several"])["gram"])
        for kind, part in (("want", rows[~covered & several]), ("covered", rows[covered])):
            if len(part):
                out.extend(_by_doc(part, kind))
    return _found_table(out)


def _fetch(shards: int):
    """From documents with their wanted spans: (shard, gram, doc_id, row, start, run, text) of each."""
    names = ["shard", "gram", "doc_id", "row", "start", "run", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, text, starts, runs, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8")
                gram = np.frombuffer(b"".join(grams), "<u8")
                shard = (mix(gram) % np.uint64(shards)).astype(np.int64).tolist()
                for s, g, a, n in zip(shard, gram.view("<i8").tolist(), np.frombuffer(b"".join(starts), "<u4").tolist(), np.frombuffer(b"".join(runs), "<u2").tolist(), strict=True):
                    out.append((s, g, doc, row, a, n, data[a : a + n + WIDTH - 1]))
            if out:
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


class _Block:
    """Spans with the suffix array over their text; `lead` is the earliest place of each class of equal windows."""

    def __init__(self, spans: list[tuple]):
        sizes = np.array([len(s[5]) for s in spans])
        self.data = np.frombuffer(b"".join(s[5] for s in spans), np.uint8)
        doc, row, start, run = (np.array([s[i] for s in spans], np.int64) for i in (1, 2, 3, 4))
        begin = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(spans)), sizes)
        inside = np.arange(len(self.data)) - begin[of]
        order = suffix_array(self.data, WIDTH)
        klass = np.cumsum(common_prefixes(self.data, order, WIDTH) < WIDTH) - 1
        real = inside[order] < run[of[order]]  # a whole window of its span
        order, klass = order[real], klass[real]
        self.doc, self.row, self.start = doc[of[order]], row[of[order]], start[of[order]] + inside[order]
        first = np.concatenate(([True], klass[1:] != klass[:-1]))
        self.klass = np.cumsum(first) - 1
        self.windows = order[first]  # one of each class, in the order of their bytes
        best = np.lexsort((self.start, self.doc, self.klass))
        self.lead = best[np.flatnonzero(first)]
        self.lead = np.stack((self.doc[self.lead], self.start[self.lead]), 1)

    def merge(self, earlier: _Block) -> None:
        """Gives classes that both blocks hold the earlier of their leads."""
        at = find(earlier.data, earlier.windows, self.data, self.windows, WIDTH)
        mine = np.flatnonzero(at >= 0)
        theirs = at[mine]
        a, b = self.lead[mine], earlier.lead[theirs]
        less = ((a[:, 0] < b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1]))[:, None]
        self.lead[mine] = earlier.lead[theirs] = np.where(less, a, b)

    def covered(self) -> np.ndarray:
        lead = self.lead[self.klass]
        hit = (self.doc != lead[:, 0]) | (self.start != lead[:, 1])
        out = np.zeros(hit.sum(), ROW)
        out["doc"], out["row"], out["start"], out["run"] = self.doc[hit], self.row[hit], self.start[hit], 1
        return out


def _shard_side(table: pa.Table) -> pa.Table:
    """Covered windows among the spans of a shard."""
    columns = [table.column(c).to_numpy() for c in ("gram", "doc_id", "row", "start", "run")]
    texts = table.column("span")
    order = np.lexsort((columns[3], columns[1], columns[0]))
    gram = columns[0][order]
    out: list[tuple] = []
    held: list[_Block] = []
    spans: list[tuple] = []
    size = 0

    def close() -> None:
        for b in held:
            rows = b.covered()
            if len(rows):
                out.extend(_runs(rows))
        held.clear()

    for n, i in enumerate(order):
        text = texts[int(i)].as_py()
        spans.append((gram[n], *(int(c[i]) for c in columns[1:]), text))
        size += len(text)
        last = n + 1 == len(order)
        ends = last or gram[n + 1] != gram[n]
        if last or size >= SHARD_BLOCK:
            block = _Block(spans)
            for other in held:  # they share the gram that this block begins with
                block.merge(other)
            held.append(block)
            spans, size = [], 0
            if ends:
                close()
    return _found_table(out)


def _runs(rows: np.ndarray) -> Iterator[tuple]:
    """Covered windows that follow each other as runs, by document."""
    rows = rows[np.lexsort((rows["start"], rows["row"], rows["doc"]))]
    new = np.concatenate(([True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["row"][1:] != rows["row"][:-1]) | (rows["start"][1:].astype(np.int64) != rows["start"][:-1].astype(np.int64) + 1)))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(rows)))
    while (long := length > 60_000).any():  # a run's length has two bytes
        first = np.sort(np.concatenate((first, first[long] + 60_000)))
        length = np.diff(np.append(first, len(rows)))
    rows = rows[first].copy()
    rows["run"] = length
    yield from _by_doc(rows, "covered")


def covered_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, row, kind, starts, runs): the windows that also start earlier, as runs of window starts.
    `docs` has doc_id, row (a hash of the text) and text."""
    known = docs.where("doc_id is not null")
    bytes_ = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-bytes_ // BUCKET_TEXT))
    rows = known.mapInArrow(_map_side(buckets), "bucket int, kind string, n int, place binary, hashes binary")
    found = materialize(rows.groupBy("bucket").applyInArrow(_bucket_side, FOUND))
    wanted = (
        found.where("kind = 'want'")
        .groupBy("doc_id", "row")
        .agg(F.collect_list(F.struct("starts", "runs", "grams")).alias("w"))
        .select("doc_id", "row", F.col("w.starts").alias("starts"), F.col("w.runs").alias("runs"), F.col("w.grams").alias("grams"))
    )
    spans = known.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "starts", "runs", "grams")
    fetched = spans.mapInArrow(_fetch(buckets), "shard int, gram long, doc_id long, row long, start int, run int, span binary")
    return found.where("kind = 'covered'").unionByName(fetched.groupBy("shard").applyInArrow(_shard_side, FOUND))


def removed(data: bytes, starts: list[bytes], runs: list[bytes]) -> list[tuple[int, int]]:
    """The maximal removed stretches of a text from its covered windows."""
    a = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
    b = a + np.frombuffer(b"".join(runs), "<u2") + WIDTH - 1
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.minimum(np.maximum.accumulate(b[order]), len(data))
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist(), strict=True)) if len(a) else []


def _with_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = docs.withColumn("__row", F.xxhash64("text"))
    ranges = (
        covered_ranges(docs.select("doc_id", F.col("__row").alias("row"), "text"))
        .groupBy("doc_id", "row")
        .agg(F.collect_list(F.struct("starts", "runs")).alias("w"))
        .select("doc_id", F.col("row").alias("__row"), F.col("w.starts").alias("__starts"), F.col("w.runs").alias("__runs"))
    )
    return docs, materialize(ranges)


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of `docs` (doc_id, text)."""
    docs, ranges = _with_ranges(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8")
                gone = removed(data, starts or [], runs or [])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((doc, len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole = docs.join(ranges, ["doc_id", "__row"], "left").select("doc_id", "text", "__starts", "__runs")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated stretches cut from `text`, at whole characters."""
    columns = docs.columns
    docs, ranges = _with_ranges(docs)

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, s, r in zip(text, starts, runs, strict=True):
            if t is None or s is None:
                out.append(t)
                continue
            data, at, kept = t.encode("utf-8"), 0, []
            for a, b in removed(data, list(s), list(r)):
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                kept.append(data[at:a])
                at = b
            out.append(b"".join([*kept, data[at:]]).decode("utf-8"))
        return pd.Series(out)

    joined = docs.join(ranges, ["doc_id", "__row"], "left")
    hit = F.col("__starts").isNotNull()
    return joined.withColumn("text", F.when(hit, cut("text", "__starts", "__runs")).otherwise(F.col("text"))).select(*columns)
