"""Each operator against a plain version on the small corpus, with an empty table and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from quillspark.llm import components, fingerprints, licenses, minhash, packing, pieces, pii, quality, sharding, suffix_dedup, vector_join


def smallest(links, ids):
    """The least id reachable from each."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def pack(docs, **how):
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **how)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(docs, rows, rule):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = pack(docs, rule=rule).collect()
    by_doc, by_bin = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc.pop(i), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert len(ids) > 1024 or r.length == len(ids)
            assert n == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for held in by_bin.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_bin) <= sum(r.length for r in found) / 1024 * (1.01 if rule == "norm" else 1.03) + 1


def test_packing_does_not_depend_on_the_split(spark, docs):
    many = docs.select("doc_id", "text").unionByName(spark.range(2000).selectExpr("1000 + id doc_id", "repeat('some words ', cast(1 + id % 90 as int)) text")).repartition(60)
    found = pack(many).select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in found}) <= sum(r.length for r in found) / 1024 * 1.01 + 1


def test_packing_capacities():
    sizes = np.array(random.Random(1).choices(range(1, 300), k=2000))
    for rule in ("norm", "dot"):
        for docs, cost in ((5, 1e9), (1000, 100_000), (5, 100_000)):
            bins, offsets, used = packing.fill(sizes, 1024, docs, cost, rule)
            for b in range(bins.max() + 1):
                s = sizes[bins == b]
                assert s.sum() == used[b] <= 1024 and len(s) <= docs and (s * s).sum() <= cost
                at = np.argsort(offsets[bins == b])
                assert (np.cumsum(s[at]) - s[at] == offsets[bins == b][at]).all()
        bins, _, _ = packing.fill(np.array([600, 500, 300, 200, 100]), 1024, 9, 1e9, rule)
        assert bins.max() == 1
    with pytest.raises(ValueError):
        packing.fill(np.array([2000]), 1024, 5, 1e9)


def test_components_both_ways(spark):
    draw = random.Random(13)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    want = smallest(links, range(300))
    df = spark.createDataFrame(links, "a long, b long")
    some = {x for a, b in links if a != b for x in (a, b)}
    for most in (0, 1000):
        assert {r.id: r.component for r in components.components(df, one_task=most).collect()} == {i: want[i] for i in some}


def test_sharding(docs, rows):
    n = 40
    found = sharding.shard_documents(docs, [1.0] * n).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    slots = {}
    for r in found:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, n) and 0 <= r.shard < n
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.shard_documents(docs, [1.0] * (n + 1)).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in found)


def test_sharding_weights(spark):
    ids = spark.range(20000).selectExpr("id doc_id", "cast(null as string) text")
    count = Counter(r.shard for r in sharding.shard_documents(ids, [1.0, 3.0]).collect())
    assert abs(count[1] / 20000 - 0.75) < 0.02


def plain_pii(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in kinds.items()]


def test_pii(spark, docs, rows):
    draw = random.Random(5)
    odd = ["".join(draw.choices("0123456789.@+-() ab%", k=draw.randint(1, 300))) for _ in range(400)]
    more = [(10_000 + i, t) for i, t in enumerate(odd)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    text = dict(rows + more)
    found = pii.pii_report(df).collect()
    assert len(found) == len(text)
    for r in found:
        kinds = plain_pii(text[r.doc_id])
        base = ",".join(x for k in kinds for x in k)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(k) for k in kinds], text[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans.startswith(base)


def test_pii_mask_and_own_kinds(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789, a@b.cd"), (2, None), (3, "order 123-45-6789")]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "iban [iban], ssn [ssn], [email]" and got[2] is None and got[3] == rows[2][1]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, k):
    sets = {}
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(links, ids)
    assert len(set(want.values())) < len(ids) - 40
    got = minhash.near_duplicates(docs, k, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_duplicates_by_blocks(spark):
    """One bucket whose members lie on both sides of the threshold."""
    draw = random.Random(2)
    head = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join(head + [f"t{draw.randrange(30)}" for _ in range(9)])) for i in range(400)]
    sets = {i: set(zip(w := t.split(), w[1:])) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(links, list(sets))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def plain_repeats(rows, n=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - n + 1):
            if (s := data[j : j + n]) in seen:
                gone[j : j + n] = b"\1" * n
            seen.add(s)
        out[i] = (len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def test_repeats(docs, rows):
    want = plain_repeats(rows)
    assert sum(w[1] > 0 for w in want.values()) > 50
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_report(docs).collect()}
    assert got == want


def test_repeats_of_short_periods(spark):
    draw = random.Random(11)
    rows = [(i, "".join(draw.choice(["ab" * 70, "abc" * 50, "x" * 250, "q", "é" * 55, "ab" * 49])for _ in range(draw.randint(1, 6)))) for i in range(120)]
    got = suffix_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_repeats(rows)


def vectors():
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(12, 24))
    out = [(i, [float(x) for x in centers[i % 12] + draw.normal(size=24) * (0.05 + 0.4 * (i % 5))], "l") for i in range(300)]
    out += [(300 + i, out[0][1], None) for i in range(30)] + [(400, None, "l"), (401, [0.0] * 24, "l"), (402, [float("nan")] + [1.0] * 23, "l"), (403, [None] + [1.0] * 23, "l"), (404, [float("inf")] * 24, "l")]
    return [*out, (405, [x * 3 for x in out[7][1]], "m")]


def test_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(4)
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    unit = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    at = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    links = [(ids[a], ids[b]) for a, b in at]
    assert len(links) > 500
    want, n = smallest(links, [r[0] for r in rows]), Counter(x for pair in links for x in pair)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.similar_vectors(df).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in want}


def test_vectors_of_lengths_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "SAMPLE", 1)
    draw = np.random.default_rng(8)
    rows = []
    for width in (1, 3, 24):
        for _ in range(4):
            v = draw.normal(size=width)
            rows += [(len(rows) + k, [float(x) for x in v + draw.normal(size=width) * 0.01 * k]) for k in range(3)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want, n = smallest(links, list(unit)), Counter(x for pair in links for x in pair)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in want}


def test_licenses(docs, rows):
    labels = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    text = dict(rows)
    hits = 0
    for r in licenses.scan_licenses(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[r.doc_id] or ""))
        at = [(i, v) for i in range(len(words)) for p, v in labels.items() if tuple(words[i : i + len(p)]) == p]
        hits += len(at)
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({v for _, v in at}))
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert hits >= 6


def test_license_expressions():
    assert licenses.postfix("MIT OR (A AND B WITH x)") == ["mit", "a", "b", "x", "with", "and", "or"]
    t = licenses.evaluate("MIT OR Apache-2.0 AND BSD")
    assert (t.named, t.required, t.choices) == ({"mit", "apache-2.0", "bsd"}, frozenset(), 2)
    t = licenses.evaluate("(MIT OR Apache-2.0) AND GPL-2.0 WITH cp")
    assert (t.required, t.choices, t.exceptions) == ({"gpl-2.0"}, 2, {("gpl-2.0", "cp")})
    assert licenses.scan("SPDX-License-Identifier: MIT OR GPL-2.0")[7:] == ("", 2, "") != licenses.scan("SPDX-License-Identifier: MIT AND GPL-2.0")[7:] == ("gpl-2.0,mit", 1, "")
    t = licenses.evaluate(" AND ".join(f"(a{i} OR b{i})" for i in range(100)))
    assert t.choices == 2**100 and not t.required and len(t.named) == 200
    assert licenses.evaluate("(MIT") is None and licenses.evaluate("MIT OR") is None and licenses.evaluate("") is None


def test_pieces_round_trip(docs, rows):
    found = pieces.encoding_report(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        assert r.n_chars == len(text[r.doc_id] or "")
        assert r.text_crc32 == r.decoded_crc32 == zlib.crc32((text[r.doc_id] or "").encode())


def test_pieces_are_those_of_the_model(rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, v, draw = sentencepiece.SentencePieceProcessor(model_file=path), pieces.vocabulary(path), random.Random(9)
    learned = [p for p in v.texts if p]
    texts = [t or "" for _, t in rows] + ["the house", "The  national   parks\tof\n\nCanada  ", "naïveté 12345 🙂🙂 中文字字", "aaaaaaaabbbbabab"]
    texts += ["".join(draw.choices(learned, k=draw.randint(1, 40))).replace(pieces.BLANK, " ") for _ in range(500)]
    texts += ["".join(draw.choices("  \t\nabehinorst", k=draw.randint(1, 120))) for _ in range(500)] + ["".join(draw.choices("ehinst", k=3000)), " " * 77 + "x" + " " * 33]
    for text in texts:
        assert v.encode(text).tolist() == (sp.encode(text) if text else []), text[:200]


def test_quality_held_out(spark):
    """Documents whose class shows in both views; half of the labels are held back."""
    draw = random.Random(1)
    good = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(600):
        bad = i % 2
        text = " ".join(draw.choices(["BUY", "now", "$$$", "1234"], k=60)) if bad else " ".join(draw.choices(good, k=60))
        rows.append((i, text, "en", "spam" if bad and draw.random() < 0.8 else "web", len(text)))
    docs = spark.createDataFrame([*rows, (601, None, None, None, None), rows[0]], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 300)], "doc_id long, quality int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == 602
    held = [r.kept == (r.doc_id % 2 == 0) for r in got if 300 <= r.doc_id < 600]
    assert np.mean(held) > 0.97
    rows = quality.features(docs, labels)
    taught, pool = quality.train(rows), rows.where("y is null").select("v")
    teachers = [(taught.text, taught.text_scale), (taught.meta, taught.meta_scale)]
    sums = quality._pool_sums(pool, taught.shape, teachers, [taught.text, taught.meta])
    views = quality._split(quality.shaped(quality._features(pool.toArrow().column("v").combine_chunks()), taught.shape))
    sure = quality.sigmoid(quality.margin(quality.margin(views[1], taught.meta)[:, None], taught.meta_scale))
    assert [sums[0][0], sums[1][0]] == [(sure <= 1 - quality.CONFIDENT).sum(), (sure >= quality.CONFIDENT).sum()] and sums[1][0] > 0
    x = quality._with_one(views[0][sure >= quality.CONFIDENT])
    g, h = quality._slopes(x, 1.0, taught.text)
    assert np.isclose(sums[1][1], quality.likelihood(x, 1.0, taught.text)) and np.allclose(sums[1][2], g) and np.allclose(sums[1][3], h)
    none = quality.quality_report(docs, labels.where("quality = 1")).collect()
    assert all(r.score == 0.5 and r.kept for r in none)


def test_fingerprints_find_their_copies(docs, rows):
    from pyspark.sql import functions as F

    found = fingerprints.search(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("media"))).collect()
    assert {r.id for r in found} == {i for i, _ in rows}


def test_fingerprints_of_short_recordings(spark):
    """Short near copies are found, different short texts stay apart, equal ones share a class, also where their numbers are equal."""
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(400)]
    rows, near = [], []
    for n in range(12):
        text = " ".join(draw.choices(words, k=200))[: 80 + 90 * n]
        i = 100 * (n + 1)
        rows += [(i, text), (i + 1, text + " one more"), (i + 2, text), (i + 3, " ".join(draw.choices(words, k=200))[: len(text)])]
        near.append((i, i + 1))
    flat = "same numbers " * 4
    rows += [(5001, flat + "\x01"), (5002, flat + "\x02")]
    found = fingerprints.search(spark.createDataFrame(rows, "id long, text string").selectExpr("id", "cast(text as binary) media")).collect()
    of = {r.id: r.class_id for r in found}
    text = dict(rows)
    assert all((of[a] == of[b]) == (text[a] == text[b]) for a in of for b in of)
    pairs = {(r.query_id, r.id) for r in found if r.query_id is not None}
    assert set(near) <= pairs
    assert all(i == q + 1 for q, i in pairs)


def test_fingerprints_of_unlike_and_edited_short_recordings(spark):
    """What short texts share is sound, not the silence around them; a word changed now and then leaves them alike."""
    draw = random.Random(23)
    words = ["".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    rows = [(100 * n if n < 6 else 600 + n, " ".join(draw.choices(words, k=4 + n % 9))) for n in range(70) if n]
    planted = set()
    for n in range(6):
        w = draw.choices(words, k=70 + 10 * n)
        edited = [draw.choice(words) if i % 17 == 9 else x for i, x in enumerate(w)]
        rows += [(100 * (n + 20), " ".join(w)), (100 * (n + 20) + 1, " ".join(edited))]
        planted.add((100 * (n + 20), 100 * (n + 20) + 1))
    found = fingerprints.search(spark.createDataFrame(rows, "id long, text string").selectExpr("id", "cast(text as binary) media")).collect()
    assert {(r.query_id, r.id) for r in found if r.query_id is not None} == planted


def plain_alignment(x, y, least=fingerprints.LEAST_OVERLAP):
    """Whether some stretch of frames of two long recordings differs in few bits, at any shift of samples."""
    a, b = (fingerprints.samples_of(z.encode(), 1) for z in (x, y))
    _, _, grid = fingerprints.numbers_of(b)
    for phase in range(fingerprints.HOP):
        _, _, mine = fingerprints.numbers_of(a, phase)
        for k in range(-len(mine) + least, len(grid) - least + 1):
            i, j = max(0, -k), min(len(mine), len(grid) - k)
            equal = np.bitwise_count(mine[i:j] ^ grid[i + k : j + k]) == 0
            if len(equal) >= least and np.convolve(equal, np.ones(least), "valid").max() == least:
                return True
    return False


def test_fingerprints_against_every_shift(spark):
    """Passages and near copies at any shift: what a search of all shifts finds, and what was planted, is found."""
    draw = random.Random(21)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(400)]
    some = lambda n: " ".join(draw.choices(words, k=n))[:n]
    rows, planted, passages = [], set(), {}
    for n in range(4):
        q, passage = 100 * (n + 1), some(1500)
        passages[q] = passage
        rows += [(q, some(900) + passage + some(700)), (q + 1, some(333 + 7 * n) + passage + some(500)), (q + 2, some(2500))]
        text = rows[-3][1]
        rows += [(q + 3, text[:1600] + "inserted" + text[1600:]), (q + 4, passage + some(900) + passage + some(100))]
        planted |= {(q, q + 1), (q, q + 3), (q, q + 4)}
    media = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "cast(text as binary) media")
    some_found = {(r.query_id, r.id) for r in fingerprints.search(media).collect() if r.query_id is not None}
    found = fingerprints.search(media, every_shift=True).collect()
    pairs = {(r.query_id, r.id) for r in found if r.query_id is not None}
    assert {(q, q + 3) for q in passages} <= some_found <= pairs
    text = dict(rows)
    every = {(q, i) for q in (100, 200) for i in text if i != q and plain_alignment(text[q], text[i])}
    assert {p for p in planted if p[0] in (100, 200)} <= every <= pairs and planted <= pairs
    assert all(q // 100 == i // 100 for q, i in pairs)
    offsets = {(r.query_id, r.id): r.offset for r in found if r.query_id is not None}
    for q, passage in passages.items():
        assert offsets[q, q + 1] == text[q + 1].index(passage) - text[q].index(passage)


def test_registered_search_of_every_shift(spark, tmp_path):
    """The registered query finds a shared passage wherever it lies in both texts, and a short text with a letter before it."""
    from quillspark.llm.queries import op1_chroma_search

    draw = random.Random(31)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(400)]
    some = lambda n: " ".join(draw.choices(words, k=n))[:n]
    rows, planted = [], set()
    for n in range(6):
        q, passage, short = 200 * (n + 1), some(1500), some(300 + 90 * n)
        rows += [(q, some(900) + passage + some(700)), (q + 1, some(301 + 11 * n) + passage + some(500)), (q + 2, some(2500))]
        rows += [(q + 100, short), (q + 101, "abc"[: 1 + n % 3] + short)]
        planted |= {(q, q + 1), (q + 100, q + 101)}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op1_chroma_search(spark, str(tmp_path)).collect()
    assert {(r.query_id, r.doc_id) for r in found if r.query_id is not None} == planted


def test_numbers_do_not_depend_on_what_is_made_with_them():
    """A recording's numbers are the same alone, among others, and where its work is cut; each phase's are those of its own samples."""
    draw = np.random.default_rng(5)
    many = [draw.integers(0, 256, n).astype(np.float32) / 128 - 1 for n in (5000, 1600, 2 * fingerprints.CHUNK + 5000, 1537, 40_000)]
    for step, scale in ((64, 1), (16, 1), (4, 16), (1, 16)):
        alone = [fingerprints.numbers([x], step, scale)[0] for x in many]
        together = fingerprints.numbers(many[::-1], step, scale)[::-1]
        assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    every = fingerprints.numbers([many[0]], 1)[0]
    for phase in (0, 1, 37, 63):
        assert np.array_equal(every[phase::64], fingerprints.numbers_of(many[0], phase)[2])


def test_fingerprints_of_classes_that_share_an_id(spark):
    draw = random.Random(22)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(400)]
    x, y = (" ".join(draw.choices(words, k=600)) for _ in range(2))
    rows = [(1, x), (1, y), (100, x + " and more"), (200, y + " and more"), (None, x)]
    found = fingerprints.search(spark.createDataFrame(rows, "id long, text string").selectExpr("id", "cast(text as binary) media")).collect()
    assert sum(r.query_id is None for r in found) == 5
    assert sorted((r.query_id, r.id) for r in found if r.query_id is not None) == [(100, 1), (200, 1)]


def test_unlike_vectors_that_share_an_id(spark):
    """Links are a vector's own, whoever else has its id; a repeated row is another vector."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (3, [0.01, 0.99]), (4, [0.98, 0.02]), (4, [0.98, 0.02]), (5, [-1.0, 0.0]), (5, None)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_join.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True), (5, 0, 5, True)])


@pytest.mark.parametrize(
    "make",
    [
        pack, lambda d: sharding.shard_documents(d, [1.0] * 3), pii.pii_report, minhash.near_duplicates, suffix_dedup.dedup_report, licenses.scan_licenses,
        lambda d: pieces.encoding_report(d, public_tokenizers.path("piece_bpe_32k.model")), lambda d: quality.quality_report(d, d.selectExpr("doc_id", "cast(n_chars as int) quality")),
        lambda d: fingerprints.search(d.selectExpr("doc_id id", "cast(text as binary) media")), lambda d: vector_join.similar_vectors(d.selectExpr("doc_id vec_id", "array(cast(n_chars as float)) embedding")),
    ],
    ids=["pack", "shard", "pii", "near", "repeats", "licences", "pieces", "quality", "prints", "vectors"],
)
def test_empty_and_repeated_rows(make, docs, empty):
    assert make(empty).collect() == []
    twice = docs.union(docs.limit(5))
    n = twice.count()
    got = make(twice).collect()
    assert len(got) >= n and {r[0] for r in got} >= {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize(
    ("make", "free"),
    [
        (pii.pii_report, ()), (minhash.near_duplicates, ()), (suffix_dedup.dedup_report, ()), (licenses.scan_licenses, ()), (lambda d: sharding.shard_documents(d, [1.0] * 3), ("slot",)),
        (lambda d: pieces.encoding_report(d, public_tokenizers.path("piece_bpe_32k.model")), ()), (pack, ("sequence_id", "offset")),
    ],
    ids=["pii", "near", "repeats", "licences", "shard", "pieces", "pack"],
)
def test_a_repeated_row_repeats_its_result(make, free, docs):
    """Twice the row, twice its result; a row's place among others may differ."""
    few = docs.where("doc_id > 60 and doc_id < 130")
    row = few.orderBy("doc_id").limit(1)
    (one,) = row.collect()
    got = [r.asDict() for r in make(few.unionByName(row)).collect() if r.doc_id == one.doc_id]
    alone = [r.asDict() for r in make(few).collect() if r.doc_id == one.doc_id]
    plain = lambda rows: sorted(repr({k: v for k, v in r.items() if k not in free}) for r in rows)
    assert plain(got) == sorted(2 * plain(alone))
