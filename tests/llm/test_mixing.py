"""Mixing of sources against a plain version, with buckets small enough that the sample ends in a cut of a cut."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from quillspark.llm import mixing

KINDS = "doc_id long, text string, source string, size string, src long"


def plain_targets(words, weights=(5.0, 2.0, 1.0), share=1.5, epochs=2.0):
    """Shares by weight; what capped sources leave is shared anew until none is above its cap."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = {}, set(order)
    while left:
        rest = share * sum(words.values()) - sum(capped.values())
        given = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if given[s] > epochs * words[s]]
        if not over:
            return capped | given
        for s in over:
            capped[s] = epochs * words[s]
            left.remove(s)
    return capped


def plain_mix(rows):
    """(doc_id, size, taken) by sorting each source whole, cut at the same ranks."""
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    words = Counter()
    for _, s, n in sizes:
        words[s] += n
    goals, out = plain_targets(dict(words)), []
    for s, goal in goals.items():
        mine = [(i, n) for i, x, n in sizes if x == s]
        weight = lambda n: 2.0 ** (-mixing.DAMPING * n.bit_length())
        low, high = 0.0, 1e12  # expected copies are c * weight, at most two
        for _ in range(300):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(2.0, c * weight(n)) * n for _, n in mine) < goal else (low, c)
        copies = [min(2.0, high * weight(n)) if n else 0.0 for _, n in mine]
        copies = [round(x) if abs(x - round(x)) < 1e-9 else x for x in copies]
        ranked, taken = [], {}
        for k, ((i, n), x) in enumerate(zip(mine, copies, strict=True)):
            taken[k], p = math.floor(x), x - math.floor(x)
            if p > 0 and n:
                u = (int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
                ranked.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p), -1 if i is None else i, n, k))
        lacking = goal - sum(taken[k] * n for k, (_, n) in enumerate(mine))
        ranked.sort()
        some, z = ranked, lambda r: r[0]
        for _ in range(2):
            cuts = min(mixing.CUTS, max(1, -(-len(some) // mixing.FEW)))
            parts = defaultdict(list)
            for r in some:
                parts[math.floor(z(r) * cuts)].append(r)
            for part in sorted(parts):
                if sum(r[2] for r in parts[part]) >= lacking or part == max(parts):
                    break
                lacking -= sum(r[2] for r in parts[part])
                for r in parts[part]:
                    taken[r[3]] += 1
            some = parts[part] if parts else []
            z = lambda r, z=z, cuts=cuts, part=part if parts else 0: z(r) * cuts - part
        got = set()
        for r in some:
            if r[2] <= lacking:
                got.add(r[3])
                lacking -= r[2]
        place = {r[3]: j for j, r in enumerate(some)}
        tries = [(abs(lacking - r[2] + t), place[r[3]], place.get(k, -1), r[3], k) for r in some if r[3] not in got for t, k in [(0, -1)] + [(x[2], x[3]) for x in some if x[3] in got]]
        if tries and min(tries)[0] < lacking:
            got = got - {min(tries)[4]} | {min(tries)[3]}
        for k in got:
            taken[k] += 1
        out += [(i, n, n * taken[k]) for k, (i, n) in enumerate(mine)]
    return goals, out


def rows_of(seed, n):
    draw = random.Random(seed)
    text = lambda: draw.choice([None, "", " ", "\x1c a b"]) if draw.random() < 0.05 else " ".join("x" * draw.randint(1, 3) for _ in range(int(draw.paretovariate(1.0) * 5)))
    return [(i, text(), draw.choices(["a", "b", "é", "z", "", None], [8, 1, 2, 3, 1, 1])[0]) for i in range(n)]


@pytest.mark.parametrize(("few", "cuts", "n"), [(1024, 4096, 300), (8, 5, 800)])
def test_against_plain(spark, monkeypatch, few, cuts, n):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "CUTS", cuts)
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], KINDS).repartition(5)
    got = mixing.mix(docs).collect()
    goals, want = plain_mix(rows)
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == sorted(want)
    for r in got:
        assert r.target == pytest.approx(goals[r.source]) and r.taken <= 2 * r.size
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    if few > 100:  # the fewer documents meet at the end, the less near
        assert all(abs(taken[s] - g) <= max(30, 0.01 * g) for s, g in goals.items())
    assert sorted(mixing.mix(docs.repartition(3)).collect()) == sorted(got)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, KINDS)
    assert mixing.mix(make([])).collect() == []
    assert [(r.size, r.taken, r.target) for r in mixing.mix(make([(1, None, None, "", 0), (2, " ", "a", "", 0)])).collect()] == [(0, 0, 0.0)] * 2
    # repeated rows, null ids and one source: half of the words come again
    got = mixing.mix(make([(1, "a b c d", "s", "", 0)] * 10 + [(None, "e f", "s", "", 0)] * 10)).collect()
    assert len(got) == 20 and sum(r.taken for r in got) == 90 and all(r.taken in (r.size, 2 * r.size) for r in got)


def test_inclusion_follows_the_weights(spark):
    """Over many seeds a document is taken about as often as its expected copies say."""
    rows = [(i, "w " * (4 if i % 2 else 64), "a") for i in range(200)] + [(1000 + i, "w " * 40, "b") for i in range(200)]
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], KINDS).coalesce(1)
    counts, seeds = Counter(), 6
    for seed in range(seeds):
        for r in mixing.mix(docs, weights=(1.0, 5.0), share=0.6, seed=str(seed)).collect():
            counts[r.source, r.size] += r.taken / r.size
    short, long = counts["a", 4] / 100 / seeds, counts["a", 64] / 100 / seeds
    assert short / long == pytest.approx(2.0 ** (4 * mixing.DAMPING), rel=0.25)
