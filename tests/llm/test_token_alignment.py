"""Alignment of tokenizers against whole texts encoded by both libraries and walked byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from quillspark.llm import token_alignment

HOW = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
KINDS = "doc_id long, text string, block long, words string, n_a string"


@pytest.fixture(scope="module")
def plain():
    """Of each text its groups, links of token places and ids, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(HOW[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=HOW[3])
    # the usual table of printable stand-ins for bytes
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in own} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in own)}

    def align(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return None
        links, groups, i, j, at_a, at_b = [], [([], [])], 0, 0, 0, 0
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            end_a, end_b = at_a + len(of_a[i]), at_b + len(of_b[j])
            if end_a <= end_b:
                groups[-1][0].append(ids_a[i])
            if end_b <= end_a:
                groups[-1][1].append(ids_b[j])
            if end_a == end_b:
                groups.append(([], []))
            i, at_a = (i + 1, end_a) if end_a <= end_b else (i, at_a)
            j, at_b = (j + 1, end_b) if end_b <= end_a else (j, at_b)
        return ids_a, ids_b, groups[:-1], links

    return align


def expected(align, rows):
    found = [(i, align(t)) for i, t in rows]
    total = Counter(x for _, f in found if f for x in f[3])
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    for i, f in found:
        if f is None:
            yield (i, 0, 0, 0, 0, 0, 0, "")
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        yield (i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(total[x] == best[x[1]] for x in f[3]), sum(total[x] for x in f[3]), hashlib.sha256(text.encode()).hexdigest())


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\n  b \n", "\n", "\t x", "x \t", "a\x1c b", "a\x85 b", "a\xa0b \xa0 c", "　x 　", "a  b", "\x00 a\x00", "▁", "a▁b c", "<|endoftext|> x<|endoftext|>",
    "<s> </s> <unk> <0x41>", "naïve Grün 中文 字 🙂🙂 ️", "don't I'LL we've 's 'S", "1234567 12 3", "é" * 300, "ab" * 3000, "a " * 500, " " * 70 + "x" + " " * 33 + "y", "é ́", "ﬁ ½ Å", "﻿x �",
]


def texts():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(1, 9))) for _ in range(200)] + ["\n", "\t", "", " ", "Zürich,", "(x)", "\x1d", "\xa0", "🙂", "'s"]
    made = [draw.choice([" ", "", "\n"]).join(draw.choices(words, k=draw.randint(1, 80))) for _ in range(120)]
    wild = ["".join(draw.choices("ab \n\t'1é▁ \xa0<|>🙂\r\x0b", k=draw.randint(1, 40))) for _ in range(300)]
    rows = list(enumerate(ODD + made + wild))
    return rows + rows[40:60] + [(None, "a null id")]


@pytest.mark.parametrize("block", [32 << 20, 700])
def test_against_plain(spark, plain, block):
    rows = texts()
    docs = spark.createDataFrame([(*r, 3, "clash", "x") for r in rows], KINDS).repartition(4)
    got = token_alignment.alignment_report(docs, *HOW, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(plain, rows), key=repr)
    assert sum(r.n_a > 0 for r in got) > 200


def test_corpus(docs, rows, plain):
    got = token_alignment.alignment_report(docs, *HOW).collect()
    assert sorted(map(tuple, got)) == sorted(expected(plain, rows))


def test_groups_and_counts(spark, plain):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.groups for r in token_alignment.aligned_groups(docs, *HOW).collect()}
    total, sizes = Counter(), token_alignment.Tokenizers(*HOW).a_bytes
    for i, text in rows:
        want = plain(text)
        assert [(g.a, g.b) for g in found[i]] == (want[2] if want else [])
        ends = np.cumsum([sum(len(sizes[x]) for x in g.a) for g in found[i]]).tolist()
        assert [g.end for g in found[i]] == ends and [g.start for g in found[i]] == [0, *ends][: len(ends)]
        total.update(want[3] if want else ())
    counts = token_alignment.link_counts(docs, *HOW).collect()
    assert {(r.a_id, r.b_id): r.total for r in counts} == total
    assert all(r.best == (r.total == max(n for (_, b), n in total.items() if b == r.b_id)) for r in counts[:300])


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert token_alignment.alignment_report(make([]), *HOW).collect() == []
    assert [tuple(r) for r in token_alignment.alignment_report(make([(1, None), (2, "")]), *HOW).collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_owners():
    a, b, cuts = token_alignment.owners(np.array([2, 3, 1]), np.array([1, 4, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)] and cuts.tolist() == [0, 5]
    assert all(len(x) == 0 for x in token_alignment.owners(np.zeros(0, int), np.zeros(0, int)))
