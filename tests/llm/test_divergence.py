"""The audit of sources against whole-number sums in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from quillspark.llm import divergence

KINDS = "lang string, text string, source string, value long, block string, item string"


def share(count, total, kept):
    return 1 + 1_000_000_000 * (count + 2) // (total + 2 * kept)


def apart(p, q):
    return (p - q) ** 2 // (p + q)


def plain(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) of rows (lang, text, source)."""
    held, docs, out = {}, Counter(), []
    for lang, text, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        held.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(found)
        docs.update((lang or "", w) for w in set(found))
    for lang, groups in held.items():
        terms = [w for (x, w), n in docs.items() if x == lang and n >= least]
        whole = {w: sum(c[w] for c in groups.values()) for w in terms}
        total = {s: sum(c[w] for w in terms) for s, c in groups.items()}
        p = {s: {w: share(c[w], total[s], len(terms)) for w in terms} for s, c in groups.items()}
        q = {w: share(n, sum(whole.values()), len(terms)) for w, n in whole.items()}
        for s, c in groups.items():
            pairs = [(-sum(apart(p[s][w], p[t][w]) for w in terms), t) for t in groups if t != s]
            leading = [(-apart(p[s][w], q[w]), w) for w in terms if c[w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(leading)[:top])):
                out += [(lang, s, part, item, -v, n + 1) for n, (v, item) in enumerate(items)]
    return sorted(out)


def corpus(n=400):
    draw = random.Random(9)
    words = [draw.choice(["", "É", "中"]) + "".join(draw.choices("abcdeXYZ", k=draw.randint(1, 3))) for _ in range(150)]
    sources = [None, "", *"abcdefghi", "ß", "zz"]
    rows = [(draw.choice(["en", "en", "de", None]), " ".join(draw.choices(words[: draw.choice([10, 150])], k=draw.randint(0, 40))) + draw.choice(["", "!x_1", "\x00", "@Q[`{"]), draw.choices(sources, range(len(sources), 0, -1))[0]) for _ in range(n)]
    return [*rows, ("xx", "lone words", "a"), ("xx", None, "b"), ("xx", "", "c"), ("en", "x " * 3000, "long"), ("en", None, "silent"), *[("en", "same text again", "a")] * 30]


@pytest.mark.parametrize(("heavy", "postings"), [(0.5, 1 << 16), (0.0, 40), (9.0, 40)])
def test_against_plain(spark, monkeypatch, heavy, postings):
    """With both parts, all terms dense, and all terms sparse; in one block and in many."""
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "clash", "x") for r in rows], KINDS).repartition(6)
    got = divergence.source_divergence(docs, heavy=heavy, postings=postings).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_corpus(docs):
    rows = [(r.lang, r.text, r.source) for r in docs.collect()]
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == plain(rows)


def test_sums_of_large_counts(monkeypatch):
    """Counts far beyond what a product of 64 bits holds, and tiles of a few rows."""
    monkeypatch.setattr(divergence, "TILE", 24)
    draw = np.random.default_rng(4)
    counts = draw.integers(0, 10**13, (60, 8)) * (draw.random((60, 8)) < draw.random((60, 1)))
    totals, kept = counts.sum(axis=0), 60
    term, group = np.nonzero(counts)
    want = [[sum(apart(share(int(x), int(totals[g]), kept), share(int(y), int(totals[h]), kept)) for x, y in zip(counts[:, g], counts[:, h], strict=True)) if g != h else 0 for h in range(8)] for g in range(8)]
    for heavy in (0.0, 0.5, 2.0):
        assert divergence.pair_sums(term, group, counts[term, group], 60, totals, kept, heavy).tolist() == want


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "lang string, text string, source string")
    assert divergence.source_divergence(make([])).collect() == []
    got = divergence.source_divergence(make([(None, None, None), ("", "a b", "s"), ("de", "", "s")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
    # the same row ten times over is ten documents
    got = divergence.source_divergence(make([("en", "a a b", "s")] * 10 + [("en", "c", "t")])).collect()
    assert sorted(map(tuple, got)) == plain([("en", "a a b", "s")] * 10 + [("en", "c", "t")])
