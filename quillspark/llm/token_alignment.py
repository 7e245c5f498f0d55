"""Operator 12: alignment of two tokenizers over the same bytes.

A is a byte-level BPE (ranks), B a SentencePiece BPE with byte fallback; both read a
blank and the text. Each byte has an owner in A and one in B (`owners`: token numbers
repeated over the bytes of each token). Where the pair of owners changes, a new link
(overlap of two tokens) begins; where both change at once, both tokenizers cut, and the
tokens between two cuts are a group.

Neither tokenizer has a token from a word into the blank behind it, so a text falls into
words with the blanks before them, and links and groups never reach over their borders.
A task therefore numbers the distinct words of a block of texts, aligns each once, and
keeps a text as the numbers of its words. (Where a vocabulary has pieces with inner
blanks, a text is one word.) How often a pair of ids is linked in the corpus is summed up
from one row for each block and pair, never for each link; the sums return to the blocks
that hold the pair, where words and then texts add them up. Blocks hold `BLOCK` bytes of
text or a little more, or one text; the texts' word numbers are the largest table written,
some four bytes a word.

Defined results: texts that are null, empty or not the same bytes in both tokenizers (the
blank mark U+2581, for instance) have no tokens, zeros and an empty digest; strings of
special tokens are plain text; repeated rows count each and give repeated results; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK, BATCH = 32 << 20, 4 << 20
MARK = "▁"
#: Blanks of any kind, as any of the pattern engines sees them, before a plain blank.
_ODD = re.compile(r"[\s\x1c-\x1f\x85] |^ | $")
_WORD = re.compile(r"(?s) .*?(?:(?<=[^\s\x1c-\x1f\x85])(?= +[^ ])|\Z)")


class Tokenizers:
    """Ids of words in A and B, and the bytes of each id."""

    def __init__(self, tokenizer_json: str, ranks: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._json, self._slow = tokenizer_json, None
        self._b = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.a_bytes[i] = token
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.by_word = not any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not sp.is_byte(i))

    def a(self, text: str) -> list[int]:
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as e:  # a Rust panic on input that its pattern engine cannot take
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._json)
                self._slow.encode_special_tokens = True
            return self._slow.encode(text, add_special_tokens=False).ids

    def b(self, words: list[str]) -> list[list[int]]:
        return self._b.encode(words, num_threads=1)

    def words(self, text: str) -> list[str]:
        """A text in words, each without its first blank (both tokenizers put one before it)."""
        if not self.by_word:
            return [text]
        if "  " in text or _ODD.search(text):
            return [w[1:] for w in _WORD.findall(" " + text)]
        return text.split(" ")


@lru_cache(2)
def tokenizers(*how: str) -> Tokenizers:
    """One for each worker."""
    return Tokenizers(*how)


def owners(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of A and of B in each link, and the byte offsets at which both begin a token.
    The sizes are those of the tokens' bytes, none of them 0, with the same sum."""
    a = np.repeat(np.arange(len(a_sizes), dtype=np.int32), a_sizes)
    b = np.repeat(np.arange(len(b_sizes), dtype=np.int32), b_sizes)
    new_a, new_b = (np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])) for x in (a, b))
    at = np.flatnonzero(new_a | new_b)
    return a[at], b[at], np.flatnonzero(new_a & new_b)


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """The distinct words of a block: counts, links as pairs of ids, and each word's groups as text."""

    def __init__(self, t: Tokenizers):
        self.t = t
        names = [str(i).encode() for i in range(max(len(t.a_bytes), len(t.b_bytes)))]
        self._name = np.array([[n + end for end in (b",", b"|", b";", b"")] for n in names], dtype=object)
        self.clear()

    def clear(self) -> None:
        self.number = _Numbered()
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; all 0 where the bytes differ
        self.good = np.zeros(0, bool)
        self.groups: list[bytes] = []
        self._links: list[np.ndarray] = []

    def align(self) -> None:
        """Aligns the words that were numbered since the last call, all at once."""
        new = list(self.number)[len(self.groups) :] if len(self.groups) < len(self.number) else []
        if not new:
            return
        t = self.t
        ids = [(a, b) for a, b in zip((t.a(" " + w) for w in new), t.b(new), strict=True)]
        good = np.array([b"".join(map(t.a_bytes.__getitem__, a)) == b"".join(map(t.b_bytes.__getitem__, b)) == (" " + w).encode("utf-8") for w, (a, b) in zip(new, ids, strict=True)])
        a_of, b_of = ([x[side] if ok else [] for x, ok in zip(ids, good, strict=True)] for side in (0, 1))
        a, b = (np.fromiter((i for x in of for i in x), np.int64) for of in (a_of, b_of))
        a_sizes, b_sizes = np.fromiter((len(t.a_bytes[i]) for i in a), np.int64, len(a)), np.fromiter((len(t.b_bytes[i]) for i in b), np.int64, len(b))
        n_a, n_b = (np.fromiter(map(len, of), np.int64, len(new)) for of in (a_of, b_of))
        link_a, link_b, cuts = owners(a_sizes, b_sizes)
        word_of_a = np.repeat(np.arange(len(new)), n_a)
        starts = [np.cumsum(x) - x for x in (a_sizes, b_sizes)]
        group_a, group_b = (np.searchsorted(cuts, x, "right") - 1 for x in starts)
        word_of_group = word_of_a[np.searchsorted(group_a, np.arange(len(cuts)))]
        counts = np.column_stack((n_a, n_b, np.bincount(word_of_group, minlength=len(new)), np.bincount(word_of_a[link_a], minlength=len(new))))
        self.counts, self.good = np.concatenate((self.counts, counts)), np.concatenate((self.good, good))
        self._links.append((a[link_a] << 32) | b[link_b])
        # groups as text: A's tokens of a group, B's tokens of it, the next group
        same = lambda g: np.append(g[1:] == g[:-1], False)
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = self._name[a, np.where(same(group_a), 0, 1)]
        last = np.append(word_of_group[1:] != word_of_group[:-1], True)[group_b] if len(b) else np.zeros(0, bool)
        out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self._name[b, np.where(same(group_b), 0, np.where(last, 3, 2))]
        ends = np.cumsum(n_a + n_b).tolist()
        parts = out.tolist()
        self.groups += [b"".join(parts[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def links(self) -> np.ndarray:
        """The pairs of all links, word by word."""
        return np.concatenate(self._links) if self._links else np.zeros(0, np.int64)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
#: Rows of texts (with the numbers of their words) and, last of its block, one of the words: their links as places in the block's pairs.
WRITTEN = "block long, is_block boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, ends binary, links binary, pairs binary, counts binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SCHEMA = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in WRITTEN.split(", "))])


def _numbered(batches: Iterator[pa.RecordBatch], words: Words, most: int = BATCH) -> Iterator[tuple[list, int]]:
    """Texts (doc_id, numbers of their words; None without text) in lists of about `most` characters, with their number; their words are aligned."""
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            parts = words.t.words(text) if text else []
            held.append((doc_id, np.fromiter(map(words.number.__getitem__, parts), np.int32, len(parts)) if text else None))
            size += len(text) if text else 0
            if size >= most:
                words.align()
                yield held, size
                held, size = [], 0
    words.align()
    if held:
        yield held, size


def _rows(held: list, words: Words, block: int) -> tuple[list[tuple], np.ndarray]:
    """The rows of some texts, and how often each word stands in those that have tokens."""
    rows, used = [], np.zeros(len(words.number), np.int64)
    for doc_id, at in held:
        if at is None or not words.good[at].all():
            rows.append((block, False, doc_id, 0, 0, 0, 0, "", b"", None, None, None, None))
            continue
        used += np.bincount(at, minlength=len(used)) if len(at) > len(used) // 8 else 0
        if len(at) <= len(used) // 8:
            np.add.at(used, at, 1)
        digest = hashlib.sha256(b";".join(map(words.groups.__getitem__, at.tolist()))).hexdigest()
        rows.append((block, False, doc_id, *words.counts[at].sum(axis=0).tolist(), digest, at.astype("<i4").tobytes(), None, None, None, None))
    return rows, used


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _block_row(block: int, words: Words, used: np.ndarray) -> tuple:
    """The words of a block, with how often its texts link each pair of ids."""
    ends = np.cumsum(words.counts[:, 3])
    pairs, at = np.unique(words.links(), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, at, np.repeat(used, words.counts[:, 3]))
    some = [x.tobytes() for x in (ends.astype("<i8"), at.astype("<i4"), pairs.astype("<i8"), counts.astype("<i8"))]
    return (block, True, None, 0, 0, 0, 0, "", b"", *some)


def _aligned_blocks(how: tuple[str, str, str, str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, words, used = TaskContext.get().partitionId() << 32, 0, Words(tokenizers(*how)), np.zeros(0, np.int64)

        for held, n in _numbered(batches, words, min(BATCH, least)):
            rows, more = _rows(held, words, block)
            used = np.concatenate((used, np.zeros(len(more) - len(used), np.int64))) + more
            yield _batch(rows)
            size += n
            if size >= least:
                yield _batch([_block_row(block, words, used)])
                block, size, used = block + 1, 0, np.zeros(0, np.int64)
                words.clear()
        if size or len(used):
            yield _batch([_block_row(block, words, used)])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, counts = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), block)), pa.array(pairs[some]), pa.array(counts[some])], names=["block", "pair", "n"])


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of one block with the corpus-wide counts of their links."""
    is_block = left.column("is_block").to_numpy(zero_copy_only=False)
    docs, word_rows = left.filter(pa.array(~is_block)), left.filter(pa.array(is_block))
    at = [np.zeros(0, np.int64)] * docs.num_rows
    totals = np.zeros((2, 0), np.int64)
    if word_rows.num_rows:
        one = {c: np.frombuffer(word_rows.column(c)[0].as_py(), k) for c, k in (("ends", "<i8"), ("links", "<i4"), ("pairs", "<i8"))}
        count, best = np.zeros(len(one["pairs"]), np.int64), np.zeros(len(one["pairs"]), np.int64)
        place = np.searchsorted(one["pairs"], right.column("pair").to_numpy())
        count[place], best[place] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(np.stack((best, count))[:, one["links"]], axis=1)), axis=1)
        totals = sums[:, one["ends"]] - sums[:, np.concatenate(([0], one["ends"][:-1]))]
        at = [np.frombuffer(w.as_py(), "<i4") for w in docs.column("words")]
    n_best, count_sum = np.array([totals[:, i].sum(axis=1) for i in at]).reshape(-1, 2).T.astype(np.int64)
    return pa.table([docs.column("doc_id"), *(docs.column(c) for c in NUMBERS), pa.array(n_best), pa.array(count_sum), docs.column("groups_sha256")], names=[c.split()[0] for c in RESULT.split(", ")])


def _written(docs: DataFrame, how: tuple[str, str, str, str], block: int = BLOCK) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned_blocks(how, block), WRITTEN))


def _counted(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, n), and for each pair its total and whether it is its B id's best."""
    pairs = written.where("is_block").select("block", "pairs", "counts").mapInArrow(_pairs, "block long, pair long, n long")
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1))  # at most a row for each id of A
    return pairs, totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def link_counts(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, model: str) -> DataFrame:
    """a_id, b_id, total and best (whether no other id of A is linked with b_id more often) of each pair of ids that `docs` link."""
    totals = _counted(_written(docs, (tokenizer_json, ranks, pattern, model)))[1]
    return totals.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b_id"), "total", "best")


def alignment_report(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, model: str, block: int = BLOCK) -> DataFrame:
    """Counts of tokens, groups and links of each text, how its links stand in the corpus, and a digest of its groups."""
    written = _written(docs, (tokenizer_json, ranks, pattern, model), block)
    pairs, totals = _counted(written)
    back = pairs.select("block", "pair").join(totals, "pair")
    texts = written.select("block", "is_block", "doc_id", *NUMBERS, "groups_sha256", "words", "ends", "links", "pairs")
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_summed, RESULT)


def aligned_groups(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, model: str) -> DataFrame:
    """doc_id and the groups of each text in order: ids of A, ids of B and the bytes (of a blank and the text) at which the group begins and ends."""
    how = (tokenizer_json, ranks, pattern, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizers(*how))
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))
        for held, _ in _numbered(batches, words):
            rows = []
            for doc_id, at in held:
                groups, end = [], 0
                for g in b";".join(map(words.groups.__getitem__, at.tolist())).split(b";") if at is not None and words.good[at].all() else ():
                    a, b = (list(map(int, side.split(b","))) for side in g.split(b"|"))
                    start, end = end, end + sum(len(words.t.a_bytes[i]) for i in a)
                    groups.append({"a": a, "b": b, "start": start, "end": end})
                rows.append((doc_id, groups))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind)], names=["doc_id", "groups"])
            words.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>,start:long,end:long>>")
