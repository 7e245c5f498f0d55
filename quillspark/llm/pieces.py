"""Operator 10: encoding and decoding with a SentencePiece vocabulary.

The ids are those of the model, a BPE model: of neighbouring pieces whose join
is a piece, those of the highest score merge first, of equal scores the leftmost.
An Aho-Corasick automaton over the pieces runs once over the text; at each
position its output links give every piece that ends there. The encoding of a
prefix has one last piece: the only one that the merges would leave next to the
last piece of what stands before it. Neighbours that merges leave alone stay
alone in any context, so these junctions decide the whole encoding (exact BPE in
one pass). A character that is no piece is written as its UTF-8 byte pieces.

No piece of such a vocabulary reaches from a word into the next blank, so the
path splits into independent stretches (a run of blanks with the word behind
it); bounded memos in each Python worker keep the paths of stretches and the
junctions it has met. One pass over each scan partition, no shuffle, one text at a time.

Decoding inverts encoding for every text, also one that holds the blank mark
U+2581 itself, which is written in byte pieces (the model takes it for a blank).

Defined results: a null text counts as empty and has no pieces; repeated rows
give repeated results; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
#: Stands for a blank mark in the text itself; no valid text has a lone surrogate.
MARK = "\udfff"
MEMO, MEMO_LENGTH, JUNCTIONS = 400_000, 48, 200_000


class Vocabulary:
    """Pieces with their scores, and the automaton over them."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """`pieces`: for each id its text, its score and its kind (normal, byte or other)."""
        import ahocorasick

        self.bytes: list[bytes] = [b""] * len(pieces)
        self.byte_id = [-1] * 256
        self.automaton = ahocorasick.Automaton()
        self.texts = [""] * len(pieces)
        self.scores: dict[str, float] = {}
        alphabet: set[str] = set()
        crossing = False
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "byte":
                b = int(piece[3:5], 16)
                self.byte_id[b], self.bytes[i] = i, bytes([b])
            elif kind == "normal" and piece:
                self.bytes[i] = piece.replace(BLANK, " ").encode("utf-8")
                self.automaton.add_word(piece, (len(piece), i))
                self.texts[i], self.scores[piece] = piece, score
                alphabet.update(piece)
                crossing |= BLANK in piece.lstrip(BLANK)
        if min(self.byte_id) < 0:
            raise ValueError("the vocabulary lacks byte pieces")
        for c in sorted(alphabet - self.scores.keys()):  # no piece alone, but merges start from it
            self.automaton.add_word(c, (1, len(self.texts)))
            self.texts.append(c)
        self.automaton.make_automaton()
        free = "".join(c for c in "\n\r\t" if c not in alphabet)
        self.stretches = None if crossing else re.compile(f"[{free}]|{BLANK}*[^{BLANK}{free}]+|{BLANK}+" if free else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.memo: dict[str, bytes] = {}
        self.junctions: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that the merges make of a short text, one merge at a time."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for j in range(len(parts) - 1):
                score = scores.get(parts[j] + parts[j + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, j
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, before: int, i: int) -> bool:
        """Whether the merges leave piece i alone behind piece `before` (-1: behind nothing that merges)."""
        known = self.junctions.get((before, i))
        if known is None:
            piece = self.texts[i]
            left = [self.texts[before]] if before >= 0 else []
            known = self.merged("".join(left) + piece) == [*left, piece]
            if len(self.junctions) >= JUNCTIONS:
                self.junctions.clear()
            self.junctions[before, i] = known
        return known

    def path(self, stretch: str) -> list[int]:
        """The ids of a stretch (blanks already marked)."""
        n = len(stretch)
        back: list[tuple[int, int]] = [(0, -1)] + [(i, -1) for i in range(n)]  # start and id (-1: bytes) of the last piece of each prefix
        for last, (length, i) in self.automaton.iter(stretch):
            start = last + 1 - length
            if back[last + 1][1] < 0 and self.stands(back[start][1], i):
                back[last + 1] = (start, i)
        out: list[int] = []
        end = n
        while end:
            start, i = back[end]
            if 0 <= i < len(self.bytes):
                out.append(i)
            else:
                c = BLANK if stretch[start] == MARK else " " if stretch[start] == BLANK else stretch[start]
                out.extend(self.byte_id[b] for b in reversed(c.encode("utf-8")))
            end = start
        return out[::-1]

    def encode(self, text: str) -> array:
        if not text:
            return array("i")
        marked = BLANK + text.replace(BLANK, MARK).replace(" ", BLANK)
        if self.stretches is None:
            return array("i", self.path(marked))
        memo, parts = self.memo, self.stretches.findall(marked)
        out = []
        for part in parts:
            ids = memo.get(part)
            if ids is None:
                ids = array("i", self.path(part)).tobytes()
                if len(part) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[part] = ids
            out.append(ids)
        return array("i", b"".join(out))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(2)
def vocabulary(model: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return Vocabulary([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            ids = pa.array([v.encode(x.as_py() or "") for x in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            text = pa.array([v.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


SCHEMA = "doc_id long, n_chars long, n_pieces long, n_byte_pieces long, ids_crc32 long, text_crc32 long, decoded_crc32 long"


def encoding_report(docs: DataFrame, model: str) -> DataFrame:
    """Counts and checksums of ids, text and decoded text, from one pass that keeps no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        of_bytes = frozenset(v.byte_id)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                ids = v.encode(text)
                crc = zlib.crc32(text.encode("utf-8"))
                rows.append((len(text), len(ids), sum(map(of_bytes.__contains__, ids)), zlib.crc32(ids.tobytes()), crc, zlib.crc32(v.decode(ids).encode("utf-8"))))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
