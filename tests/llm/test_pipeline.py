"""Each stage of the corpus pipeline against a plain version, and the stages in a row."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from quillspark.llm import pii, quality
from tokenizers import Tokenizer

from test_operators import plain_pii, smallest

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    """Tables with further columns, a repeated row, and labels that the first words decide."""
    path = str(tmp_path_factory.mktemp("sf"))
    more = docs.withColumns({"row": F.lit(1), "starts": F.lit("s"), "runs": F.lit("r"), "kept": F.lit(False), "score": F.lit(0.0), "pii": F.lit("x")})
    more.unionByName(more.where("doc_id = 1")).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("a" in (t or "a")[:40])) for i, t in rows[::2]]
    spark.createDataFrame([*labels, (labels[0][0], None), (None, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def as_rows(df):
    assert df.columns == COLUMNS
    return sorted(df.collect(), key=repr)


def plain_near(rows):
    sets = {}
    for r in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if w]
        sets.setdefault(r.doc_id, set()).update({tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = smallest(links, ids)
    return [r for r in rows if least[r.doc_id] == r.doc_id]


def plain_cut(rows, n=100):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - n + 1):
            if seen.setdefault(data[j : j + n], (r.doc_id, j)) != (r.doc_id, j):
                gone[j : j + n] = b"\1" * n
        kept = [c for c, first in zip(r.text or "", _byte_ends(r.text or ""), strict=True) if not all(gone[first[0] : first[1]])]
        text = None if r.text is None else "".join(kept)
        out.append((r.doc_id, text))
    return out


def _byte_ends(text):
    at, out = 0, []
    for c in text:
        out.append((at, at + len(c.encode())))
        at = out[-1][1]
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keep, near, cut, mask, pack = (f for _, f in corpus_pipeline.STAGES)

    kept = keep(spark, docs, folder)
    report = {r.doc_id: r.kept for r in quality.quality_report(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    first = as_rows(kept)
    assert first == sorted((r for r in docs.select(*COLUMNS).collect() if report[r.doc_id]), key=repr)
    assert 0 < sum(report.values()) < len(report)

    one = near(spark, docs, folder)
    second = as_rows(one)
    assert second == sorted(plain_near(docs.select(*COLUMNS).collect()), key=repr)

    short = cut(spark, one, folder)
    third = as_rows(short)
    assert sorted((r.doc_id, r.text or "") for r in third) == sorted((i, t or "") for i, t in plain_cut(second))
    assert all(r.text is None or r.n_chars == len(r.text) for r in third)

    masked = as_rows(mask(spark, short, folder))
    spans = {(r.doc_id, r.text): r.spans for r in pii.pii_report(short).join(short.select("doc_id", "text"), "doc_id").collect()}
    assert sorted((r.doc_id, r.text or "") for r in masked) == sorted((r.doc_id, plain_mask(r.text or "", spans[r.doc_id, r.text])) for r in third) and any(spans.values())
    base = {k: found for k, found in zip(("email", "ip", "card", "phone"), zip(*(plain_pii(r.text) for r in third), strict=True), strict=True)}
    for r, *each in zip(third, *base.values(), strict=True):  # all that the base kinds hold is masked
        assert {x for x in spans[r.doc_id, r.text].split(",") if x.split(":")[0] in base} == {x for found in each for x in found}
    assert all(r.text is None or r.n_chars == len(r.text) for r in masked)

    packed = pack(spark, short, folder).collect()
    want, tok = [], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in third:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r.doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        assert [a for a, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024
    assert len(held) <= 1.03 * sum(n for *_, n, _ in want) / 1024 + 1


def plain_mask(text, spans):
    """Every stretch that spans cover, as the kind of its first (of equal beginnings the longest) in brackets."""
    out, pos = "", 0
    for start, back, kind in sorted((int(a), -int(b), kind) for kind, a, b in (x.split(":") for x in spans.split(",") if x)):
        if start >= pos:
            out += text[pos:start] + f"[{kind}]"
        pos = max(pos, -back)
    return out + text[pos:]


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == want
