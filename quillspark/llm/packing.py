"""Operator 2: packing documents into sequences by vector best-fit.

A piece is a vector of three demands: tokens, one document, and attention cost
(the square of its length). A sequence (bin) has a capacity in each. Pieces are
taken from the longest on; of all open bins whose residuals hold a piece under
every constraint it goes to the one with the largest weighted dot-product of
demand and residual (`rule="dot"`), or to the one that is left with the smallest
weighted residual norm (`rule="norm"`). A piece that no open bin holds opens one.

Tokenizing and packing are one pass over each scan partition, `block` pieces at
a time. Bins that this leaves less than `close` full are given up: their pieces,
a few numbers each, are packed again by a second pass over far fewer and fuller
tasks, so that the number of sequences does not depend on how the table is
split. Texts never move, and a lost task's rows are simply packed again.

Ids are those of the tokenizers library for the given vocabulary, its added
tokens included. The encoder is tiktoken over the same ranks, which is about
four times as fast (tests hold one against the other); a text with an added
token, or one that tiktoken refuses, goes to tokenizers.

Defined results: a null text counts as empty and packs its end token alone;
repeated rows are packed like any others; an empty table gives an empty result;
further columns of the input are ignored; a piece that no empty sequence holds
is an error.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
BLOCK, CLOSE, SECOND = 16_384, 0.995, 200_000


@lru_cache(2)
def encoder(tokenizer_json: str, ranks: str, pattern: str):
    """A function from text to ids (uint32). `ranks` holds the vocabulary of `tokenizer_json`."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer_json, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    slow: list = []

    def exact(text: str) -> np.ndarray:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(tokenizer_json))
        return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return exact(text)
        try:
            return np.asarray(fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as e:  # a Rust panic on input that its pattern engine cannot take
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return exact(text)

    return encode


def fill(sizes: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs pieces of these sizes; the bin (from 0) and the offset in it of each, and the tokens in each bin."""
    if len(sizes) and (sizes.min() < 1 or sizes.max() > max_tokens or max_docs < 1 or float(sizes.max()) ** 2 > max_cost):
        raise ValueError("a piece has at least one token and fits an empty sequence")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used: list[int] = []
    # residuals of the open bins, each as a share of its capacity; `name` is the bin
    left = np.empty((3, len(sizes)))
    name = np.empty(len(sizes), np.int64)
    w = np.asarray(weights)
    slack, n, i = 1e-9, 0, 0
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    least = int(ordered[-1]) / max_tokens if len(sizes) else 0.0
    for i, size in zip(order.tolist(), ordered.tolist(), strict=True):
        d = np.array([size / max_tokens, 1 / max_docs, size * size / max_cost])
        at = -1
        if n:
            r = left[:, :n]
            fits = np.flatnonzero((r[0] >= d[0] - slack) & (r[1] >= d[1] - slack) & (r[2] >= d[2] - slack))
            if len(fits):
                some = r[:, fits]
                score = (w * d) @ some if rule == "dot" else -(w @ (some - d[:, None]) ** 2)
                at = int(fits[np.argmax(score)])
        if at < 0:
            at, n = n, n + 1
            left[:, at], name[at] = 1.0, len(used)
            used.append(0)
        b = int(name[at])
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        left[:, at] -= d
        if left[0, at] < least - slack or left[1, at] < d[1] - slack:  # nothing that is still to come fits
            n -= 1
            left[:, at], name[at] = left[:, n], name[n]
    return bins, offsets, np.asarray(used, np.int64)


def _packed(rows: list[tuple], base: int, max_tokens: int, max_docs: int, max_cost: float, rule: str, close: int) -> tuple[pa.RecordBatch, int]:
    """Rows (doc_id, piece, start, length, ids_crc32) with their places; sequence_id is null in bins less full than `close`."""
    columns = list(zip(*rows, strict=True))
    lengths = np.asarray(columns[3], dtype=np.int64)
    bins, offsets, used = fill(lengths, max_tokens, max_docs, max_cost, rule)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    out = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    out += [pa.array(bins + base, mask=used[bins] < close), pa.array(offsets)]
    return pa.RecordBatch.from_arrays(out, names=NAMES), len(used)


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    ranks: str,
    pattern: str,
    max_tokens: int = 1024,
    max_docs: int = 1024,
    max_cost: float | None = None,
    rule: str = "norm",
    end_id: int = 2,
    block: int = BLOCK,
    close: float = CLOSE,
) -> DataFrame:
    """One row per piece of `docs` (doc_id, text) with its sequence and place there."""
    most = float(max_tokens) ** 2 if max_cost is None else max_cost
    how = (max_tokens, max_docs, most, rule)

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder(tokenizer_json, ranks, pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % max_tokens or max_tokens
                cuts = [0, *range(first, len(ids) + 1, max_tokens)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    yield doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)

    def packer(read, first: int, least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, held = first + (TaskContext.get().partitionId() << 32), []
            for row in read(batches):
                held.append(row)
                if len(held) >= block:
                    out, n = _packed(held, base, *how, least)
                    yield out
                    base, held = base + n, []
            if held:
                yield _packed(held, base, *how, least)[0]

        return run

    once = materialize(docs.select("doc_id", "text").mapInArrow(packer(tokenized, 0, int(close * max_tokens)), SCHEMA))
    open_ = once.where("sequence_id is null")
    tasks = max(1, -(-open_.count() // SECOND))
    twice = open_.coalesce(tasks).mapInArrow(packer(again, 1 << 62, 0), SCHEMA)
    return once.where("sequence_id is not null").unionByName(twice)
